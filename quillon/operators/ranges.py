"""Order statistics and running sums by ranges of values: exact, without sorting a key in one task.

Rows are first counted by value. Approximate quantiles of a key's values, a bounded sketch, cut them into
ranges; a task sorts one range, the ranges' sums are run through in order, and both together give each value
what stands before it. Equal values are one row, so neither a hot key nor ties gather in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def cumulated(per: DataFrame, keys: list[str], order: str, sums: list[str], parts: int = PARTS) -> DataFrame:
    """per (a row a key and value of `order`) with, for each of `sums`, <sum>_before over the key's smaller values and <sum>_total."""
    cuts = per.groupBy(*keys).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts).alias("__cuts"))  # a row a key
    placed = _beside(per, cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")
    own = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    of_part = placed.groupBy(*keys, "__part").agg(*[F.sum(s).alias(s) for s in sums])  # a row a range
    ahead = of_part.select(*keys, "__part", *[F.coalesce(F.sum(s).over(own), F.lit(0)).alias(f"__{s}_ahead") for s in sums], *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums])
    within = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumns({f"__{s}_within": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    rows = _beside(rows, ahead, [*keys, "__part"])
    return rows.select(*per.columns, *[(F.col(f"__{s}_within") + F.col(f"__{s}_ahead")).alias(f"{s}_before") for s in sums], *[f"{s}_total" for s in sums])


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with `small`, whose keys may be NULL too; without keys it is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(small))
    renamed = small.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(renamed, same).drop(*[f"__k{i}" for i in range(len(keys))])


def counted(rows: DataFrame, keys: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """The values that aren't NULL, once each, with n, n_before and n_total of the key."""
    return cumulated(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value, ["n"], parts)


def at_rank(value: str, place: Column) -> Column:
    """Over `counted` rows: the value at a place from 0."""
    return F.max(F.when((F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n")), F.col(value)))


def interpolated(value: str, p: float) -> Column:
    """Over `counted` rows: the quantile between the neighbouring places of (n - 1) p."""
    at = (F.col("n_total") - 1) * p
    low, high = at_rank(value, F.floor(at)), at_rank(value, F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))
