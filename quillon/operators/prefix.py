"""Matched-prefix scores (SCO1-10): the smallest prefix of a ranking that reaches a recall target.

rankings: setting_id, query_id, memory_id, rank; labels: query_id, memory_id, relevant, scope_ok, policy_ok,
lifecycle_ok (nullable booleans). One window sum and one aggregate a scorer.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import rate
from quillon.functions.status import admissible_status, usable_status


ROWS = 1 << 18  # ranked rows of a task


def tasks(rankings: DataFrame) -> int:
    """How many tasks score written rankings: as many as hold ROWS each, where Spark would join shuffled rows up to a size in bytes, packed."""
    return max(1, ceil(rankings.count() / ROWS))


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, "setting_id", "query_id")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def bounds(status: Column, inside: Column, prefix: str) -> dict[str, Column]:
    """SCO3: known rate, coverage, lower and upper bound of violations among the rows inside."""
    n, known, bad = F.count_if(inside), _count(inside & status.isNotNull()), _count(inside & ~status)
    return {f"{prefix}_known_rate": rate(bad, known), f"{prefix}_label_coverage": rate(known, n), f"{prefix}_lower_bound": rate(bad, n), f"{prefix}_upper_bound": rate(bad + n - known, n)}


def labelled(labels: DataFrame) -> DataFrame:
    adm = admissible_status(F.col("scope_ok"), F.col("policy_ok"), F.col("lifecycle_ok"))
    return labels.withColumn("admissible", adm).withColumn("usable", usable_status(F.col("relevant"), F.col("admissible")))


def matched(rows: DataFrame, keys: list[str], hit: Column, target: Column | float) -> DataFrame:
    """SCO1-2: adds retrieved, recall, feasible and inside (the row lies in the matched prefix). rows have anchor_total."""
    target = F.lit(float(target)) if not isinstance(target, Column) else target
    w = Window.partitionBy(*keys)
    cum = F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__cum", cum).withColumn("__reached", F.try_divide(F.col("__cum").cast("double"), F.col("anchor_total")) >= target)
    out = out.withColumn("__first", F.min(F.when(F.col("__reached"), F.col("rank"))).over(w))
    return out.withColumn("inside", F.coalesce((F.col("rank") <= F.col("__first")) & (target > 0), F.lit(False)))


def assessed(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """JOI1: ranked rows with their labels; one that has none raises, for without it ranks and prefixes would shift."""
    known = labels.withColumn("__known", F.lit(True))
    out = rankings.join(known, ["query_id", "memory_id"], "left")
    checked = F.when(F.col("__known"), F.col("rank")).otherwise(F.raise_error(F.lit("a ranked memory has no assessment")).cast("int"))
    return out.withColumn("rank", checked).drop("__known")


def score_route(rankings: DataFrame, labels: DataFrame | None, runs: DataFrame, target: float, anchors: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """SCO4: a row for each of `runs` (setting_id, source, group_id, query_id, candidates_scored, route_width).

    labels: a row for each of a query's candidates; of the ranked ones only, if anchors (query_id,
    anchor_total over all candidates) are given; None, if the rankings have them beside them. `parts`: the tasks
    that the ranked rows are dealt to. No anchors: recall, feasible and matched metrics are NULL. Infeasible: matched metrics are NULL. Target 0:
    an empty prefix, whose rates are NULL.
    """
    if anchors is None:
        anchors = labelled(labels).groupBy("query_id").agg(_count(F.col("usable")).alias("anchor_total"))
    beside = rankings if labels is None else assessed(rankings.select("setting_id", "query_id", "memory_id", "rank"), labels)
    rows = _dealt(labelled(beside).join(anchors, "query_id"), parts)
    rows = matched(rows, ["setting_id", "query_id"], F.col("usable"), target)
    inside, rel, adm = F.col("inside"), F.col("relevant"), F.col("admissible")
    n = F.count_if(inside)

    def of_prefix(c: Column) -> Column:
        return rate(_count(inside & c), n)

    per = rows.groupBy("setting_id", "query_id").agg(
        _count(F.col("usable")).alias("anchor_retrieved"),
        n.alias("matched_prefix_count"),
        *[c.alias(k) for k, c in {**bounds(F.col("usable"), inside, "non_usable"), **bounds(adm, inside, "admissibility")}.items()],
        of_prefix(rel & adm).alias("known_relevant_admissible_rate"),
        of_prefix(rel & ~adm).alias("known_relevant_inadmissible_rate"),
        of_prefix(~rel & adm).alias("known_irrelevant_admissible_rate"),
        of_prefix(~rel & ~adm).alias("known_irrelevant_inadmissible_rate"),
        of_prefix(rel.isNotNull() & adm.isNotNull()).alias("joint_label_coverage"),
        of_prefix(~F.col("scope_ok")).alias("wrong_scope_exposure_rate"),
        of_prefix(~F.col("policy_ok")).alias("policy_disallowed_exposure_rate"),
        of_prefix(~F.col("lifecycle_ok")).alias("lifecycle_incompatible_exposure_rate"),
        of_prefix(adm.isNull()).alias("unresolved_admissibility_rate"),
    )
    out = runs.join(anchors, "query_id", "left").join(per, ["setting_id", "query_id"], "left")
    out = out.withColumns({"anchor_total": F.coalesce("anchor_total", F.lit(0)), "anchor_retrieved": F.coalesce("anchor_retrieved", F.lit(0))})
    recall = rate(F.col("anchor_retrieved"), F.col("anchor_total"))
    out = out.withColumn("evidence_recall", recall).withColumn("feasible", F.col("evidence_recall") >= target)
    return out.withColumn("matched_prefix_count", F.when(F.coalesce("feasible", F.lit(False)), F.coalesce("matched_prefix_count", F.lit(0))))


def score_matched_recall(rankings: DataFrame, statuses: DataFrame, runs: DataFrame, grid: DataFrame) -> DataFrame:
    """SCO5, SCO8: full and residual upper risk over a grid of (target, cost), a row for each of `runs` and point; infeasible costs `cost`.

    statuses: query_id, memory_id, anchor, full, residual, wrong_scope; runs: setting_id, query_id, anchor_total (> 0)
    and more. A run without a ranked row has recall 0, returns nothing of a wrong scope, and pays the cost.
    """
    keys = ["setting_id", "query_id", "target", "cost"]
    ranked = rankings.select("setting_id", "query_id", "memory_id", "rank").join(runs.select("setting_id", "query_id", "anchor_total"), ["setting_id", "query_id"])
    rows = matched(assessed(ranked, statuses).crossJoin(F.broadcast(grid)), keys, F.col("anchor"), F.col("target"))  # the grid is a handful of settings
    inside, n = F.col("inside"), F.count_if(F.col("inside"))
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("width"),
        _count(F.col("anchor")).alias("retrieved"),
        _count(F.col("wrong_scope")).alias("wrong"),
        rate(_count(inside & F.col("wrong_scope")), n).alias("matched_wrong_scope"),
        rate(_count(inside & ~F.coalesce("full", F.lit(False))), n).alias("full_upper"),
        rate(_count(inside & ~F.coalesce("residual", F.lit(False))), n).alias("residual_upper"),
        _count(inside & ~F.col("full")).alias("violations"),
        _count(inside & ~F.coalesce("full", F.lit(False))).alias("upper_violations"),
    )
    per = runs.crossJoin(F.broadcast(grid)).join(per, keys, "left")
    per = per.withColumn("evidence_recall", rate(F.coalesce("retrieved", F.lit(0)), F.col("anchor_total"))).withColumn("feasible", F.col("evidence_recall") >= F.col("target"))

    def reached(c: str) -> Column:
        return F.when(F.col("feasible"), F.col(c))

    return per.select(
        *runs.columns, "target", "cost", "evidence_recall", "feasible", reached("full_upper").alias("full_upper"), reached("residual_upper").alias("residual_upper"),
        F.coalesce(reached("full_upper"), "cost").alias("penalized_full"), F.coalesce(reached("residual_upper"), "cost").alias("penalized_residual"),
        reached("violations").alias("known_violations"), F.when(F.col("feasible"), F.col("violations") > 0).alias("any_known_violation"), reached("upper_violations").alias("upper_violations"),
        F.coalesce(rate(F.col("wrong"), F.col("width")), F.lit(0.0)).alias("returned_wrong_scope"), reached("matched_wrong_scope").alias("matched_wrong_scope"), F.coalesce("width", F.lit(0)).alias("route_width"),
    )


def score_fixed_route(route: DataFrame, cases: DataFrame, target: float, parts: int | None = None) -> DataFrame:
    """SCO6-7: a filtered frozen ranking. Risk over the prefix (empty: 0), exposure rates over the whole route (empty: 0).

    route: setting_id, query_id, memory_id, rank, anchor, scope_ok, policy_ok, lifecycle_ok; cases: setting_id, query_id, anchor_total >= 1.
    """
    rows = matched(_dealt(route.join(cases, ["setting_id", "query_id"]), parts), ["setting_id", "query_id"], F.col("anchor"), target)
    rows = rows.withColumn("admissible", admissible_status(F.col("scope_ok"), F.col("policy_ok"), F.col("lifecycle_ok")))
    inside, adm, n = F.col("inside"), F.col("admissible"), F.count("*")
    per = rows.groupBy("setting_id", "query_id").agg(
        n.alias("route_width"), _count(F.col("anchor")).alias("hits"), F.count_if(inside).alias("prefix"),
        rate(_count(inside & ~adm), _count(inside & adm.isNotNull())).alias("known_rate"), rate(_count(inside & ~F.coalesce(adm, F.lit(False))), F.count_if(inside)).alias("upper"),
        rate(_count(~F.col("scope_ok")), n).alias("wrong_scope_exposure_rate"), rate(_count(~F.col("policy_ok")), n).alias("policy_disallowed_exposure_rate"),
        rate(_count(~F.col("lifecycle_ok")), n).alias("lifecycle_incompatible_exposure_rate"), rate(_count(adm.isNull()), n).alias("unresolved_exposure_rate"),
    )
    out = cases.join(per, ["setting_id", "query_id"], "left").withColumn("evidence_recall", rate(F.coalesce("hits", F.lit(0)), F.col("anchor_total"))).withColumn("feasible", F.col("evidence_recall") >= target)
    zero = F.lit(0.0) if target == 0 else F.lit(None).cast("double")
    return out.select(
        "setting_id", "query_id", "evidence_recall", "feasible", F.when(F.col("feasible"), F.coalesce("prefix", F.lit(0))).alias("matched_prefix_count"),
        F.coalesce("known_rate", zero).alias("known_violation_rate"), F.coalesce("upper", zero).alias("upper_risk"), F.coalesce("upper", zero, F.lit(1.0)).alias("penalized_upper_risk"),
        F.coalesce("route_width", F.lit(0)).alias("route_width"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("wrong_scope_exposure_rate", "policy_disallowed_exposure_rate", "lifecycle_incompatible_exposure_rate", "unresolved_exposure_rate")],
    )


def scope_diagnostics(rankings: DataFrame, labels: DataFrame | None, runs: DataFrame, target: float, parts: int | None = None) -> DataFrame:
    """SCO8-9: of each run the share of wrong scope among all returned rows, and in the matched prefix (NULL where infeasible); nothing returned: 0 and NULL.

    runs: setting_id, query_id, anchor_total (> 0); labels, parts: as for score_route.
    """
    beside = rankings if labels is None else assessed(rankings.select("setting_id", "query_id", "memory_id", "rank"), labels)
    ranked = _dealt(labelled(beside).join(runs.select("setting_id", "query_id", "anchor_total"), ["setting_id", "query_id"]), parts)
    rows = matched(ranked, ["setting_id", "query_id"], F.col("usable"), target)
    wrong, inside = ~F.col("scope_ok"), F.col("inside")
    per = rows.groupBy("setting_id", "query_id").agg(F.count("*").alias("returned"), rate(_count(wrong), F.count("*")).alias("returned_wrong_scope_rate"), rate(_count(inside & wrong), F.count_if(inside)).alias("matched_wrong_scope_rate"))
    out = runs.select("setting_id", "query_id").join(per, ["setting_id", "query_id"], "left")
    return out.select("setting_id", "query_id", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("returned_wrong_scope_rate", F.lit(0.0)).alias("returned_wrong_scope_rate"), "matched_wrong_scope_rate")


def passed_on(value: Column) -> Column:
    """SCO10: a cost or latency beside a score: NULL stays, anything negative or not finite raises."""
    good = value.isNull() | ((value >= 0) & ~F.isnan(value) & (value < float("inf")))
    return F.when(good, value.cast("double")).otherwise(F.raise_error(F.lit("costs must be finite and not negative")).cast("double"))
