"""Data-quality predicates and evidence rows (JOI8-12, AGG23, EVD1-6, EXE1-3, NAT8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of an evidence row.
EVIDENCE = ("claim_id", "family", "population", "source", "contrast", "metric", "estimate", "ci95_lower", "ci95_upper", "n", "notes")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """JOI8, EXE2: keys of rows that other lacks; pending requests are those without a record."""
    return rows.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_anti")


def expectations(checks: dict[str, DataFrame]) -> DataFrame:
    """One row a check with the number of rows that break it."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check"), "violations") for k, df in checks.items()])


def require(checks: DataFrame) -> None:
    """Raises if any check is broken."""
    broken = checks.where("violations > 0").collect()  # a row a check
    if broken:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in broken))


def interval_errors(rows: DataFrame, estimate: str = "estimate", lower: str = "ci95_lower", upper: str = "ci95_upper") -> DataFrame:
    """Bounds that are out of order or not finite."""
    e, a, b = F.col(estimate), F.col(lower), F.col(upper)
    return rows.where(F.isnan(e) | (a > e) | (e > b) | (a.isNull() != b.isNull()))


def forbidden_columns(rows: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(rows.columns) & set(names))


def one(rows: DataFrame, **criteria) -> DataFrame:
    """JOI10: exactly one row, else it raises when read."""
    found = rows.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in criteria.items()]))
    n = found.agg(F.count("*").alias("__n"))
    return found.crossJoin(F.broadcast(n)).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("not exactly one row")).cast("boolean"))).drop("__n")


def drift(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """JOI11-12: keys whose values differ by more than the tolerance, relative or absolute, or that one side lacks."""
    x, y = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    size = F.greatest(F.abs("left_value"), F.abs("right_value"), F.lit(1.0))
    same = F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance * size, F.col("left_value").isNull() & F.col("right_value").isNull())
    return x.join(y, keys, "full").where(~same)


def evidence(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """EVD1-5: any table as evidence rows; what isn't given is NULL."""
    kinds = {"estimate": "double", "ci95_lower": "double", "ci95_upper": "double", "n": "bigint"}
    return rows.select(*[(F.lit(None) if k not in columns else F.lit(columns[k]) if isinstance(columns[k], str) else columns[k]).cast(kinds.get(k, "string")).alias(k) for k in EVIDENCE])


def reader_effects(table: DataFrame, claim: str, reader: str, source: str, metrics: list[str]) -> DataFrame:
    """EVD2-5: a published table (reader, source, n, and <metric>, <metric>_sd of each metric) as evidence rows: each reader's own rows by source, and its macro over exactly two sources; readers are never pooled.

    A row's interval is the mean's at 1.96 standard errors; macros have none.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate"), (1.96 * F.col(f"{m}_sd") / F.sqrt("n")).alias("half")) for m in metrics])).alias("x")
    rows = table.select(reader, source, "n", parts).select(reader, source, "n", "x.*")
    own = evidence(rows, claim_id=claim, family="reader", population=F.col(reader), source=F.col(source), metric=F.col("metric"), estimate=F.col("estimate"), ci95_lower=F.col("estimate") - F.col("half"), ci95_upper=F.col("estimate") + F.col("half"), n=F.col("n"), notes="readers_not_pooled")
    macro = two_source_macro(rows, [reader, "metric"], source, "estimate")
    return own.unionByName(evidence(macro, claim_id=claim, family="reader", population=F.col(reader), source="equal_source_macro", metric=F.col("metric"), estimate=F.col("estimate"), notes="readers_not_pooled"))


def contrasts(evidence_rows: DataFrame, treated: str, base: str, source: str) -> DataFrame:
    """EVD3: the difference of two populations by metric in one source, each looked up as exactly one row."""
    sides = {k: evidence_rows.where((F.col("population") == p) & (F.col("source") == source)).groupBy("metric").agg(F.count("*").alias(f"n_{k}"), F.max("estimate").alias(k)) for k, p in (("t", treated), ("b", base))}
    rows = sides["t"].join(sides["b"], "metric", "full")
    single = (F.coalesce("n_t", F.lit(0)) == 1) & (F.coalesce("n_b", F.lit(0)) == 1)
    return rows.select("metric", F.when(single, F.col("t") - F.col("b")).otherwise(F.raise_error(F.lit("not exactly one row a side")).cast("double")).alias("estimate"))


def finite_mean(value: Column) -> Column:
    """FN8: the mean, where a NULL or a number that isn't finite raises instead of being left out."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.avg(F.when(good, value.cast("double")).otherwise(F.raise_error(F.lit("a mean needs finite numbers")).cast("double")))


def two_source_macro(rows: DataFrame, keys: list[str], source: str, value: str) -> DataFrame:
    """EVD2: the mean of exactly two sources."""
    return rows.groupBy(*keys).agg(F.when(F.countDistinct(source) == 2, F.avg(value)).otherwise(F.raise_error(F.lit("not exactly two sources")).cast("double")).alias(value))


def cost(input_bytes: Column, max_output_tokens: Column, price_in: float, price_out: float) -> Column:
    """EXE1: an upper bound: no token is shorter than a byte."""
    return (input_bytes * price_in + max_output_tokens * price_out) / 1e6


def sanitised(rows: DataFrame, domain: str, identifier: str, allowed: list[str]) -> DataFrame:
    """NAT8: identifiers as domain-separated hashes, and listed columns only."""
    return rows.select(F.sha2(F.concat(F.lit(domain), F.col(identifier).cast("string")), 256).alias("token"), *allowed)


def receipt(requests: DataFrame, records: DataFrame, identifier: str, payload: str, *, digits: int = 3) -> DataFrame:
    """EXE2: requests, records, pending, and a digest of the whole set of records: a hash of the hashes of its parts by identifier, so no task gathers all."""
    one = F.sha2(F.concat_ws("\0", F.col(identifier).cast("string"), payload), 256)
    parts = records.select(F.substring(F.sha2(F.col(identifier).cast("string"), 256), 1, digits).alias("part"), one.alias("h")).groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = parts.agg(F.sum("n").alias("records"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("response_set_sha256"))
    pending = missing(requests, records, [identifier]).agg(F.count("*").alias("pending"))
    return requests.agg(F.count("*").alias("requests")).crossJoin(pending).crossJoin(whole)  # one row each


def in_same_order(a: DataFrame, b: DataFrame, identifier: str, place: str) -> DataFrame:
    """JOI9: rows at the same place that differ in identifier, or that one side lacks."""
    x, y = a.select(place, F.col(identifier).alias("left_id")), b.select(place, F.col(identifier).alias("right_id"))
    return x.join(y, place, "full").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def figure_rows(panels: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """EVD6: several tables as one tidy table with their panel's name."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("panel"), *columns) for k, df in panels.items()])
