"""Scans and sinks (SRC1-14, SNK1-5): explicit schemas, fail-fast reading, manifests."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASES = (
    "source string, group_id string, query struct<query_id:string,namespace:string,text:string,embedding:array<double>,intent:string,policy_purpose:string>, "
    "memories array<struct<memory_id:string,namespace:string,text:string,embedding:array<double>,released_order:double,lifecycle_state:string,"
    "released_policy:struct<content_disclosure_allowed:boolean,operation_trace_allowed:boolean>,assessment:struct<relevance:string,scope:string,policy_allowed:boolean>>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1, SRC4, SRC5, SRC9, SRC11: blank lines are skipped, a bad line fails, gzip is transparent, a folder is one table."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6: one JSON document a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC8: header row, empty is NULL."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("nullValue", "").option("mode", "FAILFAST").csv(path)


def case_tables(cases: DataFrame) -> dict[str, DataFrame]:
    """SRC2: nested cases as queries, memories, policy and assessments. Routing tables hold no scorer-only field."""
    q = cases.select("source", "group_id", "query.*", "memories").withColumns({"intent": F.coalesce("intent", F.lit("unknown")), "policy_purpose": F.coalesce("policy_purpose", F.lit("content_disclosure"))})
    m = q.select("source", "query_id", "intent", F.explode("memories").alias("m"))
    return {
        "queries": q.drop("memories"),
        "memories": m.select("source", "query_id", "m.memory_id", F.col("m.namespace").alias("memory_namespace"), F.col("m.text").alias("text"), F.col("m.embedding").alias("m_embedding"), "m.released_order", F.coalesce("m.lifecycle_state", F.lit("unknown")).alias("lifecycle_state")),
        "policy": m.where("m.released_policy IS NOT NULL").select("source", "query_id", "m.memory_id", F.col("m.released_policy.content_disclosure_allowed").alias("content_allowed"), F.col("m.released_policy.operation_trace_allowed").alias("trace_allowed")),
        "assessments": m.select("source", "query_id", "m.memory_id", F.coalesce("m.assessment.relevance", F.lit("unknown")).alias("relevance"), F.coalesce("m.assessment.scope", F.lit("unknown")).alias("scope"), F.col("m.assessment.policy_allowed").alias("policy_allowed"), F.coalesce("m.lifecycle_state", F.lit("unknown")).alias("lifecycle_state"), F.col("intent").alias("query_intent")),
    }


def load_settings(path: str, known: set[str]) -> list[dict]:
    """SRC3: a protocol of schema version 1; unknown setting fields fail."""
    with open(path) as f:
        protocol = json.load(f)
    if protocol.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    for s in protocol["settings"]:
        if extra := set(s) - known:
            raise ValueError(f"unknown setting fields: {sorted(extra)}")
    return protocol["settings"]


def checkpoint_view(rows: DataFrame, case: str, order: str, which: str = "first") -> DataFrame:
    """SRC10: the first or last record of each case in an append-only log."""
    w = Window.partitionBy(case).orderBy(order if which == "first" else F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def unsorted_ids(rows: DataFrame, identifier: str, order: str, *, part: int = 1 << 20) -> DataFrame:
    """SRC4: rows whose identifier isn't greater than that of the row before them; order numbers the rows.

    Each part of `part` numbers is one window; its first row is compared with the last one of the part before.
    """
    placed = rows.withColumn("__part", F.floor(F.col(order) / part))
    inner = placed.withColumn("before", F.lag(identifier).over(Window.partitionBy("__part").orderBy(order)))
    ends = placed.groupBy("__part").agg(F.min(order).alias("__first"), F.max_by(identifier, order).alias("__last"))  # a row a part
    ends = ends.select(F.col("__part").alias("__p"), "__first", F.lag("__last").over(Window.partitionBy(F.lit(1)).orderBy("__part")).alias("__prior"))
    out = inner.join(ends, F.col("__part") == F.col("__p")).withColumn("before", F.when(F.col(order) == F.col("__first"), F.col("__prior")).otherwise(F.col("before")))
    return out.where(F.col("before") >= F.col(identifier)).drop("__part", "__p", "__first", "__prior")


def unique_ids(rows: DataFrame, identifier: str) -> DataFrame:
    """SRC5, SRC9: rows as they are; an identifier that comes twice raises."""
    n = rows.groupBy(F.col(identifier).alias("__id")).agg(F.count("*").alias("__n"))
    once = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate identifier")).cast("boolean"))
    return rows.join(n, F.col(identifier).eqNullSafe(F.col("__id"))).where(once).drop("__id", "__n")


def not_empty(rows: DataFrame) -> DataFrame:
    """SRC1: an empty input is refused."""
    if rows.isEmpty():
        raise ValueError("the input is empty")
    return rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; where that is unset, below the warehouse, or in a temporary folder if all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="quillon-") if spark.sparkContext._jsc.sc().isLocal() else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at a new path: cuts lineage, and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SRC7, SNK3: path, bytes and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_jsonl(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    """SNK1, SNK4: keys sorted, NULLs kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK2: with a header; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")
    df.write.option("header", "true").csv(path)


def manifest(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """SNK3: digests of the data files below a folder, and the table's row count."""
    return file_digests(spark, path).where(F.col("path").rlike(r"/part-[^/]*$")).withColumn("row_count", F.lit(rows).cast("bigint"))


def dataset_digest(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: one row, sha256: a digest of a data set's files by content, whatever their names and order."""
    files = file_digests(spark, path).where(F.col("path").rlike(r"/part-[^/]*$"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))  # a digest a file


def bound_overlay(overlay: DataFrame, base: DataFrame, digest: DataFrame, key: str) -> DataFrame:
    """SRC7: overlay rows (key, base_sha256 and more) with `binding`: bound, stale (made for other bytes than the base has now), or unknown (the base lacks the key)."""
    rows = overlay.crossJoin(F.broadcast(digest)).join(base.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")  # one row
    binding = F.when(~F.col("base_sha256").eqNullSafe(F.col("sha256")), "stale").when(F.col("__known").isNull(), "unknown").otherwise("bound")
    return rows.withColumn("binding", binding).drop("__known", "sha256")
