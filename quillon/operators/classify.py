"""Discrimination, calibration, threshold choice and agreement (CLS1-13). rows: label (0 or 1) and score, NULL labels left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import rate, uniform
from quillon.functions.status import drop_candidate
from quillon.operators import ranges


def binary_rows(rows: DataFrame, gold: Column, score: Column, keys: list[str]) -> DataFrame:
    """CLS1: positive is gold False."""
    return rows.where(gold.isNotNull()).select(*keys, (~gold).cast("int").alias("label"), score.alias("score"))


def binary_metrics(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """CLS2."""
    y, s = F.col("label"), F.col("score")
    hit = (s >= threshold).cast("int")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("known_count"), F.sum(y).alias("positive_count"), F.avg(y).alias("positive_rate"), F.avg((hit == y).cast("double")).alias("accuracy"),
        ((F.avg(F.when(y == 1, hit)) + F.avg(F.when(y == 0, 1 - hit))) / 2).alias("balanced_accuracy"), F.avg((s - y) * (s - y)).alias("brier"),
    )


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """CLS3: Mann-Whitney with mid-ranks; NULL with one class only. Ranks come from running counts by ranges of distinct scores."""
    per = ranges.cumulated(rows.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("label").alias("pos")), keys, "score", ["n"])
    mid = F.col("n_before") + (F.col("n") + 1) / 2
    sums = per.withColumn("r", mid * F.col("pos")).groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(*keys, rate(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("roc_auc"))


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """CLS4: steps over tied scores; what lies at or above a score is the total less what stands before it."""
    per = ranges.cumulated(rows.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("label").alias("pos")), keys, "score", ["n", "pos"])
    step = per.withColumn("precision", (F.col("pos_total") - F.col("pos_before")) / (F.col("n_total") - F.col("n_before"))).withColumn("gain", rate(F.col("pos"), F.col("pos_total")))
    return step.groupBy(*keys).agg(F.sum(F.col("gain") * F.col("precision")).alias("pr_auc"))


def calibration_error(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """CLS5: bins between the edges i / bins, the last closed on the right; edges are compared, not computed from scores."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    placed = rows.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("score"))))
    per = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.abs(F.avg("label") - F.avg("score")).alias("gap"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def multiclass_brier(gold: Column, labels: list[str], *p: Column) -> Column:
    """CLS6, CLS13."""
    return sum(((q - (gold == x).cast("double")) * (q - (gold == x).cast("double")) for x, q in zip(labels, p, strict=True)), F.lit(0.0))


def threshold_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """CLS7-8: decisions under each (v, u). rows: p_violation, p_unknown, admissible (nullable), required."""
    x = rows.crossJoin(F.broadcast(grid))  # a stated grid
    x = x.withColumn("dropped", drop_candidate(F.col("p_violation"), F.col("p_unknown"), F.col("v"), F.col("u")))
    d, bad, known = F.col("dropped"), F.coalesce(~F.col("admissible"), F.lit(False)), F.col("admissible").isNotNull()
    return x.groupBy("v", "u").agg(
        F.count("*").alias("candidate_count"), F.count_if(known).alias("known_count"), F.count_if(bad).alias("known_violation_count"), F.count_if(d).alias("dropped_count"),
        F.count_if(d & ~known).alias("dropped_unknown_gold"), rate(F.count_if(d & bad), F.count_if(d & known)).alias("violation_precision"), rate(F.count_if(d & bad), F.count_if(bad)).alias("violation_recall"),
        rate(F.count_if(d & F.col("required")), F.count_if(F.col("required"))).alias("false_deny"), rate(F.count_if(F.col("u").isNull() | (F.col("p_unknown") <= F.col("u"))), F.count("*")).alias("abstention_coverage"),
    )


def select_threshold(decisions: DataFrame, cap: float) -> DataFrame:
    """CLS7: under the false-deny cap, the greatest (recall, precision, -false deny, v, -u); without any, a row that keeps all."""
    best = decisions.where(F.col("false_deny") <= cap).agg(F.max(F.struct("violation_recall", F.coalesce("violation_precision", F.lit(-1.0)).alias("p"), (-F.col("false_deny")).alias("d"), "v", (-F.coalesce("u", F.lit(1.0))).alias("nu"), "u", "violation_precision", "false_deny", "dropped_unknown_gold")).alias("s"))
    return best.select(F.col("s.v").alias("v"), F.col("s.u").alias("u"), F.col("s.violation_precision").alias("violation_precision"), F.coalesce("s.violation_recall", F.lit(0.0)).alias("violation_recall"), F.coalesce("s.false_deny", F.lit(0.0)).alias("false_deny"), F.coalesce("s.dropped_unknown_gold", F.lit(0).cast("bigint")).alias("dropped_unknown_gold"))


def binary_agreement(pairs: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """CLS9: exact agreement, Cohen's kappa, Gwet's AC1 from the 2 x 2 counts; chance 1 gives 1."""
    x, y = F.col(a), F.col(b)
    return agreement_of_counts(pairs.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(x & y).alias("tt"), F.count_if(x & ~y).alias("tf"), F.count_if(~x & y).alias("ft"), F.count_if(~x & ~y).alias("ff")), keys)


def agreement_of_counts(t: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same of rows that hold n and the four counts."""
    n, exact = F.col("n"), (F.col("tt") + F.col("ff")) / F.col("n")
    pa, pb = (F.col("tt") + F.col("tf")) / n, (F.col("tt") + F.col("ft")) / n
    chance, q = pa * pb + (1 - pa) * (1 - pb), (pa + pb) / 2
    ac = 2 * q * (1 - q)

    def beyond(c: Column) -> Column:
        return F.when(c == 1, F.lit(1.0)).otherwise(F.try_divide(exact - c, 1 - c))

    return t.select(*(keys or []), "n", "tt", "tf", "ft", "ff", exact.alias("exact"), beyond(chance).alias("kappa"), beyond(ac).alias("ac1"))


def quality_agreement(pairs: DataFrame, a: str, b: str, top: int = 10) -> DataFrame:
    """CLS10: exact, within one, mean absolute error, mean difference, quadratic-weighted kappa on 0 .. top.

    The expected disagreement needs only the marginals' first two moments, so no table is crossed.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    t = pairs.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("exact"), F.avg((F.abs(x - y) <= 1).cast("double")).alias("within_one"), F.avg(F.abs(x - y)).alias("mae"), F.avg(x - y).alias("mean_difference"), F.avg((x - y) * (x - y)).alias("o"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    expected = F.col("xx") + F.col("yy") - 2 * F.col("mx") * F.col("my")
    return t.select("n", "exact", "within_one", "mae", "mean_difference", F.when(expected == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.col("o"), expected)).alias("quadratic_kappa"))


def unique_stratified(rows: DataFrame, stratum: str, unit: str, n: int, seed: str) -> DataFrame:
    """CLS11: per stratum, in their order, the n units of least hash that no earlier stratum took.

    Greedy over the strata, which are few and named by the design; each step anti-joins what is taken.
    """
    strata = [r[0] for r in rows.select(stratum).distinct().orderBy(stratum).collect()]
    taken = None
    for s in strata:
        own = rows.where(F.col(stratum) == s).select(stratum, unit).distinct()
        own = own if taken is None else own.join(taken.select(unit), unit, "left_anti")
        best = own.withColumn("h", F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(stratum), F.col(unit).cast("string")), 256)).orderBy("h").limit(n).select(stratum, unit)
        taken = best if taken is None else taken.unionByName(best)
    return taken


def salted_sample(rows: DataFrame, unit: str, n: int, salt: str, whole: Column) -> DataFrame:
    """CLS12: the n units of least salted hash, and all rows of one stratum."""
    return rows.withColumn("__h", F.sha2(F.concat(F.lit(salt), F.col(unit).cast("string")), 256)).orderBy("__h").limit(n).drop("__h").unionByName(rows.where(whole)).distinct()


def hash_split(unit: Column, seed: str, share: float) -> Column:
    return uniform(seed, unit) < share
