"""Resampling and inference (STA1-16). Draws are indices by identity hash, so any engine can repeat them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import draw, rate


def replicates(units: DataFrame, strata: list[str], n: int, seed: str, *, order: str = "unit") -> DataFrame:
    """Units drawn with replacement within strata: replicate, slot and the drawn unit's columns.

    The units (clusters, scenarios or groups) are few beside the rows they sum up; all values are sums by unit already.
    """
    w = Window.partitionBy(*(strata or [F.lit(1)]))
    placed = units.withColumn("__k", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    slots = placed.select(*strata, F.col("__k").alias("slot"), F.col("__n").alias("__size")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = slots.withColumn("__k", draw(F.col("__size"), seed, *[F.col(s) for s in strata], F.col("replicate"), F.col("slot")))
    return drawn.join(placed.drop("__n"), [*strata, "__k"]).drop("__k", "__size")


def interval(values: DataFrame, value: str, keys: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """STA2: bounds by linear interpolation (type 7)."""
    tail = (1 - confidence) / 2
    return values.groupBy(*(keys or [])).agg(F.percentile(value, tail).alias("lower"), F.percentile(value, 1 - tail).alias("upper"), F.count("*").alias("replicates"))


def nearest_rank_interval(values: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """STA7-9: bounds at places round((n-1)p), halves to even."""
    tail = (1 - confidence) / 2
    ranked = values.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(value)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return ranked.agg(*[F.max(F.when(F.col("__k") == F.rint((F.col("__n") - 1) * p), F.col(value))).alias(k) for k, p in (("lower", tail), ("upper", 1 - tail))], F.count("*").alias("replicates"))


def cluster_macro_bootstrap(rows: DataFrame, cluster: str, value: str, n: int, seed: str) -> DataFrame:
    """STA1: resampled cluster means; estimate, lower, upper, replicates."""
    units = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("unit")).agg(F.avg(value).alias("mean"))
    draws = replicates(units, [], n, seed).groupBy("replicate").agg(F.avg("mean").alias("v"))
    return units.agg(F.avg("mean").alias("estimate")).crossJoin(F.broadcast(interval(draws, "v")))


def paired_bootstrap(rows: DataFrame, strata: list[str], group: str, delta: str, n: int, seed: str, *, weighting: str = "strata", nearest: bool = False) -> DataFrame:
    """STA3, STA7-9: groups resampled within strata; rows pool in a stratum, strata weigh the same (or, weighting "cases", rows do)."""
    units = rows.where(F.col(delta).isNotNull()).groupBy(*strata, F.col(group).alias("unit")).agg(F.sum(delta).alias("s"), F.count("*").alias("c"))

    def estimate(x: DataFrame, keys: list[str]) -> DataFrame:
        per = x.groupBy(*keys, *strata).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        pooled = F.avg(rate(F.col("s"), F.col("c"))) if weighting == "strata" else rate(F.sum("s"), F.sum("c"))
        return per.groupBy(*keys).agg(pooled.alias("v"))

    draws = estimate(replicates(units, strata, n, seed), ["replicate"])
    bounds = nearest_rank_interval(draws, "v") if nearest else interval(draws, "v")
    return estimate(units, []).withColumnRenamed("v", "estimate").crossJoin(F.broadcast(bounds))


def scenario_bootstrap(rows: DataFrame, axis: str, scenario: str, value: str | Column, n: int, seed: str) -> DataFrame:
    """STA4-5: scenarios resampled within an axis; mean of scenario means, axes weigh the same."""
    units = rows.groupBy(axis, F.col(scenario).alias("unit")).agg(F.avg(value).alias("mean")).where("mean IS NOT NULL")

    def estimate(x: DataFrame, keys: list[str]) -> DataFrame:
        return x.groupBy(*keys, axis).agg(F.avg("mean").alias("m")).groupBy(*keys).agg(F.avg("m").alias("v"))

    draws = estimate(replicates(units, [axis], n, seed), ["replicate"])
    return estimate(units, []).withColumnRenamed("v", "estimate").crossJoin(F.broadcast(interval(draws, "v")))


def selectivity(rows: DataFrame, axis: str, scenario: str, cell: str, value: str, high: str, low: str) -> DataFrame:
    """STA6, STA13: a scenario's gap between two cells; both are needed."""
    wide = rows.where(F.col(cell).isin(high, low)).groupBy(axis, scenario).pivot(cell, [high, low]).agg(F.avg(value))
    return wide.select(axis, scenario, (F.col(high) - F.col(low)).alias("gap")).where("gap IS NOT NULL")


def binary_agreement_bootstrap(pairs: DataFrame, a: str, b: str, unit: str, n: int, seed: str) -> DataFrame:
    """STA10: items resampled; the 2 x 2 counts of each replicate give the bounds of exact agreement, kappa and AC1.

    A resample matters by its counts only, and those are multinomial: one pass counts the cells, and each
    replicate draws its counts from them with a generator of its own, so no item is copied.
    """
    from quillon.operators.classify import agreement_of_counts

    x, y = F.col(a), F.col(b)
    cells = {"tt": x & y, "tf": x & ~y, "ft": ~x & y, "ff": ~x & ~y}
    seen = pairs.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in cells.items()])  # one row
    names = list(cells)
    rows = seen.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"), "n", *names).repartition(32, "replicate")

    def drawn(batches):
        for batch in batches:
            out = []
            for replicate, size, *counts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                stream = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"{seed}\0{replicate}".encode()).digest()[:8], "big")))
                p = np.array([*counts, size - sum(counts)]) / max(size, 1)  # the last: a status is unknown
                out.append((replicate, size, *stream.multinomial(size, p if size else [0, 0, 0, 0, 1])[:4].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["replicate", "n", *names])

    draws = agreement_of_counts(rows.mapInArrow(drawn, "replicate bigint, n bigint, tt bigint, tf bigint, ft bigint, ff bigint"), ["replicate"])
    return draws.agg(*[F.percentile(m, p).alias(f"{m}_{k}") for m in ("exact", "kappa", "ac1") for k, p in (("lower", 0.025), ("upper", 0.975))])


def sign_flip(deltas: DataFrame, value: str) -> DataFrame:
    """STA11: the exact two-sided p of the mean under all sign patterns; zeros are left out, at most 20 units remain."""
    units = deltas.where((F.col(value).isNotNull()) & (F.col(value) != 0)).select(F.col(value).alias("d"))
    units = units.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("d")) - 1)
    size = units.agg(F.count("*").alias("n"), F.abs(F.avg("d")).alias("observed"))
    size = size.withColumn("n", F.when(F.col("n") <= 20, F.col("n")).otherwise(F.raise_error(F.lit("more than 20 units")).cast("bigint")))
    patterns = size.select("n", "observed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("shiftleft(1L, cast(n as int))") - 1)).alias("pattern"))
    sums = patterns.join(F.broadcast(units)).groupBy("pattern", "observed").agg((F.sum(F.when(F.expr("(shiftright(pattern, cast(k as int)) & 1) = 1"), F.col("d")).otherwise(-F.col("d"))) / F.count("*")).alias("mean"))
    p = sums.agg(F.avg((F.abs("mean") >= F.col("observed") - 1e-15).cast("double")).alias("p"))
    return size.select(F.col("n").alias("units")).crossJoin(p).withColumn("p", F.coalesce("p", F.lit(1.0)))


def risk_difference(rows: DataFrame, exposed: str, used: str) -> DataFrame:
    """STA14."""
    x, u = F.col(exposed), F.col(used).cast("double")
    return rows.agg((F.avg(F.when(x, u)) - F.avg(F.when(~x, u))).alias("risk_difference"))


def robustness_table(deltas: DataFrame, value: str) -> DataFrame:
    """STA15: units, mean, least and greatest leave-one-out mean, counts of signs and the exact p, in one row."""
    from quillon.operators.aggregate import leave_one_out, sign_counts

    rows = deltas.where(F.col(value).isNotNull()).select(F.col(value).alias("delta"))
    return sign_counts(leave_one_out(rows, "delta")).crossJoin(sign_flip(rows, "delta").select("p"))  # one row each
