"""Candidate supports (SUP1-15): which rows of a query may be ranked.

`pairs` is long: a row a query and candidate with query_id, namespace (the query's), intent, purpose,
memory_id, memory_namespace, lifecycle_state, content_allowed, trace_allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import uniform
from quillon.functions.status import PAST, allowed_for, drop_candidate


def in_namespace() -> Column:
    """SUP2."""
    return F.col("namespace") == F.col("memory_namespace")


def policy_allows() -> Column:
    """SUP3: only an explicit False drops; a missing row or NULL is kept."""
    return ~F.coalesce(allowed_for(F.col("purpose"), F.col("content_allowed"), F.col("trace_allowed")) == F.lit(False), F.lit(False))


def lifecycle_allows() -> Column:
    """SUP4: only questions on the current state drop past states; unknown is kept."""
    return ~((F.col("intent") == "current_state") & F.col("lifecycle_state").isin(*PAST))


def governance_v2() -> Column:
    """SUP5."""
    return policy_allows() & lifecycle_allows()


def released_v1() -> Column:
    """SUP6: other intents bypass policy and lifecycle."""
    return F.when(F.col("intent") != "current_state", F.lit(True)).otherwise(governance_v2())


def current_only() -> Column:
    """SUP7: whatever the query asks."""
    return ~F.col("lifecycle_state").isin(*PAST)


def random_partition(memories: DataFrame, seed: str) -> DataFrame:
    """SUP8: namespaces permuted among memories, their sizes kept: the k-th by id takes the k-th label by hash."""
    return random_partitions(memories, [seed]).drop("seed")


def random_partitions(memories: DataFrame, seeds: list[str]) -> DataFrame:
    """SUP8 for several seeds in one plan: every memory once a seed, with the namespace dealt to it."""
    seeded = memories.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    u = uniform(F.col("seed"), F.col("source"), F.col("memory_id"))
    labels = numbered(seeded.select("seed", "source", "memory_id", F.col("memory_namespace").alias("shuffled"), u.alias("u")), ["seed", "source"], F.floor(F.col("u") * 4096), ["u", "memory_id"], "k").select("seed", "source", "k", "shuffled")
    return numbered(seeded, ["seed", "source"], F.floor(F.col("memory_id") / (1 << 16)), ["memory_id"], "k").join(labels, ["seed", "source", "k"]).drop("k", "memory_namespace").withColumnRenamed("shuffled", "memory_namespace")


def numbered(rows: DataFrame, keys: list[str], part: Column, order: list[str], out: str) -> DataFrame:
    """rows numbered from 1 within keys along `order`, of which `part` must be a non-falling function: a task sorts a part of a key, not all of it."""
    placed = rows.withColumn("__part", part)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # a row a part
    within = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return placed.withColumn("__k", within).join(sizes, [*keys, "__part"]).withColumn(out, F.col("__k") + F.col("__before")).drop("__part", "__k", "__before")


def rerank(rows: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Ranks from 1 in the order of the old rank."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def filter_ranking(rankings: DataFrame, allowed: Column, keys: list[str], limit: int) -> DataFrame:
    """SUP10-11: an order-preserving mask. limit 0 returns all that is allowed, as the known quirk has it."""
    return rerank(rankings.where(allowed), keys, limit or None)


def post_filter(rankings: DataFrame, allowed: Column, keys: list[str], depth: int, limit: int) -> DataFrame:
    """SUP9: the mask holds over the first `depth` ranks only; filter and cut don't commute."""
    return rerank(rankings.where(F.col("rank") <= depth).where(allowed), keys, limit)


def false_allow(rate: float, seed: str) -> Column:
    """SUP12: own namespace, or let in by chance; nested in the rate."""
    return in_namespace() | (uniform(seed, "false_allow", F.col("query_id"), F.col("memory_id")) < rate)


def swapped(rate: float, seed: str, alternate: Column) -> Column:
    """SUP13: some memories carry another namespace."""
    return F.when(uniform(seed, "swap", F.col("memory_id")) < rate, alternate).otherwise(F.col("memory_namespace")) == F.col("namespace")


def not_denied(status: Column) -> Column:
    """SUP14, the policy gate and the released oracle: anything but False stays."""
    return ~F.coalesce(status == F.lit(False), F.lit(False))


def text_verifier(score: Column, threshold: float) -> Column:
    """SUP14: scores below the threshold stay; every candidate must have one."""
    return F.when(score.isNull(), F.raise_error(F.lit("a candidate has no verifier score")).cast("boolean")).otherwise(score < threshold)


def inferred(p_violation: Column, p_unknown: Column, v: Column, u: Column) -> dict[str, Column]:
    """SUP15: what each inferred arm keeps; text_inferred ignores the threshold on the unknown. Every candidate must have a prediction."""
    predicted = F.when(p_violation.isNull() | p_unknown.isNull(), F.raise_error(F.lit("a candidate has no prediction")).cast("boolean")).otherwise(F.lit(True))
    return {"text_inferred": predicted & ~drop_candidate(p_violation, p_unknown, v, F.lit(None).cast("double")), "abstaining_verifier": predicted & ~drop_candidate(p_violation, p_unknown, v, u)}
