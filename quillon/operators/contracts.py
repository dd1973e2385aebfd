"""Contracts of data sets and evidence (AGG23, JOI11, EXE5): verdicts as rows, values by paths from data, imports that can be repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators.responses import entries, number, strict_json

# --- AGG23


def verdict(rows: DataFrame, checks: dict[str, tuple[Column, Column]], keys: list[str] | None = None) -> DataFrame:
    """AGG23: check, observed, expected and passed of each check (an aggregate and what it must be), all from one scan; with keys, of each of their values."""
    wide = rows.groupBy(*(keys or [])).agg(*[x.cast("double").alias(f"o{i}") for i, (x, _) in enumerate(checks.values())], *[x.cast("double").alias(f"e{i}") for i, (_, x) in enumerate(checks.values())])
    parts = [F.struct(F.lit(k).alias("check"), F.col(f"o{i}").alias("observed"), F.col(f"e{i}").alias("expected"), F.col(f"o{i}").eqNullSafe(F.col(f"e{i}")).alias("passed")) for i, k in enumerate(checks)]
    return wide.select(*(keys or []), F.explode(F.array(*parts)).alias("x")).select(*(keys or []), "x.*")


def unbalanced(rows: DataFrame, unit: list[str], cell: str, cells: list[str], each: int) -> DataFrame:
    """AGG23: units that don't hold every cell `each` times, or hold others: the unit, and its counts by cell."""
    counts = rows.groupBy(*unit).agg(*[F.count_if(F.col(cell) == c).alias(c) for c in cells], F.count("*").alias("total"))
    wrong = F.col("total") != each * len(cells)
    for c in cells:
        wrong = wrong | (F.col(c) != each)
    return counts.where(wrong)


def drift(rows: DataFrame, stratum: str, share: Column, expected: float, tolerance: float) -> DataFrame:
    """AGG23: of each stratum its share of a split, and whether that lies within the tolerance of what was announced."""
    out = rows.groupBy(stratum).agg(F.count("*").alias("n"), F.avg(share.cast("double")).alias("share"))
    return out.withColumn("passed", F.abs(F.col("share") - expected) <= tolerance)


class Refused(ValueError):
    """A table that broke its contract; nothing was published."""


def guarded_write(rows: DataFrame, path: str, checks: dict[str, tuple[Column, float]]) -> dict[str, float]:
    """Writes a table whose counters (an aggregate and its expected value each) are gathered by the write itself; published at `path` only if all hold."""
    spark, seen = rows.sparkSession, Observation(f"contract-{uuid.uuid4().hex}")
    files, at = _files(spark, path)
    if files.exists(at):
        raise Refused(f"{path} is there already")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rows.observe(seen, *[c.cast("double").alias(k) for k, (c, _) in checks.items()]).write.parquet(staged)
    got = seen.get
    broken = {k: (got[k], want) for k, (_, want) in checks.items() if got[k] != want}
    if broken:
        files.delete(_path(spark, staged), True)
        raise Refused(f"observed and expected: {broken}")
    if not files.rename(_path(spark, staged), at):
        raise Refused(f"{path} couldn't be published")
    return got


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


# --- JOI11


def at_path(value: Column, path: Column) -> Column:
    """The VARIANT at a path (an array of keys) that comes from data; NULL where a step is missing or not an object."""
    return F.aggregate(path, value, lambda v, key: entries(v)[key])


def claim_values(claims: DataFrame, artifacts: DataFrame, manifest: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """JOI11: each claim beside the value that its path finds in its artifact: claim_id, found, status.

    claims: claim_id, artifact, path (an array of keys), estimate; artifacts: artifact, body (JSON text);
    manifest: artifact, sha256. status is `ok`, or the first of: unlisted (no manifest row), absent (no
    artifact), digest, json, path, number, differs (by more than the tolerance).
    """
    bodies = artifacts.select("artifact", F.sha2("body", 256).alias("digest"), strict_json(F.col("body")).alias("value"), F.lit(True).alias("there"))
    listed = manifest.select("artifact", F.col("sha256").alias("wanted"))
    sound = listed.join(bodies, "artifact", "left")
    rows = claims.join(sound, "artifact", "left")
    step = at_path(F.col("value"), F.col("path"))
    rows = rows.withColumn("at", step).withColumn("found", number(F.col("at")))
    good = F.col("found").isNotNull() & ~F.isnan("found") & (F.abs("found") < float("inf"))
    status = (
        F.when(F.col("wanted").isNull(), "unlisted").when(F.col("there").isNull(), "absent").when(F.col("digest") != F.col("wanted"), "digest").when(F.col("value").isNull(), "json")
        .when(F.col("at").isNull(), "path").when(~good, "number").when(F.abs(F.col("found") - F.col("estimate")) > tolerance, "differs").otherwise("ok")
    )
    return rows.select("claim_id", "found", status.alias("status"))


# --- EXE5


class Checkpoints:
    """An append table of records by version at a path: one folder a commit, named after what it commits, so that a commit made twice is there once. One writer at a time."""

    SCHEMA = "request_id string, payload string, payload_sha256 string, protocol string, origin string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def records(self) -> DataFrame:
        files, at = _files(self.spark, f"{self.path}/commits")
        if not files.exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/commits/*")

    def append(self, rows: DataFrame, name: str) -> bool:
        """Whether the commit was new. Files are written aside and appear by one rename; executors may be lost meanwhile."""
        files, at = _files(self.spark, f"{self.path}/commits/{name}")
        if files.exists(at):
            return False
        aside = f"{self.path}/aside/{name}-{uuid.uuid4().hex}"
        rows.select("request_id", "payload", F.sha2("payload", 256).alias("payload_sha256"), "protocol", "origin").write.parquet(aside)
        files.mkdirs(_path(self.spark, f"{self.path}/commits"))
        return files.rename(_path(self.spark, aside), at)

    def classify(self, source: DataFrame, protocol: str, compatible: list[str]) -> DataFrame:
        """source (request_id, payload, protocol) with status: incompatible (its protocol isn't one of `compatible`), ambiguous (several payloads in the source), conflict (another payload is there), present, or new."""
        rows = source.select("request_id", "payload", F.col("protocol").alias("from_protocol"), F.sha2("payload", 256).alias("own_sha256"))
        fits = F.col("from_protocol").isin(*compatible)
        several = rows.where(fits).groupBy("request_id").agg((F.min("own_sha256") != F.max("own_sha256")).alias("ambiguous"))
        there = self.records().where(F.col("protocol") == protocol).groupBy("request_id").agg(F.max("payload_sha256").alias("payload_sha256"))
        beside = rows.join(several, "request_id", "left").join(there, "request_id", "left")
        status = (
            F.when(~fits, "incompatible").when(F.col("ambiguous"), "ambiguous").when(F.col("payload_sha256").isNull(), "new")
            .when(F.col("payload_sha256") == F.col("own_sha256"), "present").otherwise("conflict")
        )
        return beside.select("request_id", "payload", "from_protocol", status.alias("status"))

    def import_from(self, source: DataFrame, protocol: str, compatible: list[str], name: str) -> DataFrame:
        """The receipt: status and records. New records are committed under the new protocol, each payload once, as they are; everything else is only reported."""
        files, at = _files(self.spark, f"{self.path}/receipts/{name}-{uuid.uuid4().hex}")
        receipt = at.toString()
        classified = self.classify(source, protocol, compatible)
        classified.write.parquet(receipt)  # decided before the commit changes what is there
        classified = self.spark.read.schema(classified.schema).parquet(receipt)
        new = classified.where("status = 'new'").dropDuplicates(["request_id"])
        if not new.isEmpty():
            self.append(new.select("request_id", "payload", F.lit(protocol).alias("protocol"), F.col("from_protocol").alias("origin")), name)
        return classified.groupBy("status").agg(F.count("*").alias("records"), F.countDistinct("request_id").alias("requests"))
