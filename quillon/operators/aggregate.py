"""Aggregations (AGG1-28): nested macro means with explicit NULL policies, frontiers, selections, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import rate
from quillon.functions.status import penalized
from quillon.operators import ranges

SCORES = ("non_usable_known_rate", "non_usable_label_coverage", "non_usable_lower_bound", "non_usable_upper_bound", "admissibility_known_rate", "admissibility_label_coverage", "admissibility_lower_bound", "admissibility_upper_bound", "known_relevant_admissible_rate", "known_relevant_inadmissible_rate", "known_irrelevant_admissible_rate", "known_irrelevant_inadmissible_rate", "joint_label_coverage", "wrong_scope_exposure_rate", "policy_disallowed_exposure_rate", "lifecycle_incompatible_exposure_rate", "unresolved_admissibility_rate")


def aggregate_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """AGG1: NULL-skipping means and the shares of rows that can be evaluated."""
    return scores.groupBy(*keys).agg(
        F.count("*").alias("query_count"), F.avg(F.col("evidence_recall").isNotNull().cast("double")).alias("recall_evaluable_rate"), F.avg("evidence_recall").alias("mean_evidence_recall"),
        F.avg(F.col("feasible").cast("double")).alias("feasible_rate"), F.avg(F.col("matched_prefix_count").isNotNull().cast("double")).alias("matched_recall_evaluable_rate"),
        *[F.avg(c).alias(c) for c in SCORES], F.avg("route_width").alias("mean_route_width"), F.avg("matched_prefix_count").alias("mean_matched_prefix_count"), F.avg("candidates_scored").alias("mean_candidates_scored"),
    )


def nested_macro(rows: DataFrame, keys: list[str], source: str, metrics: dict[str, Column], *, strict: tuple[str, ...] = ()) -> DataFrame:
    """AGG8: query means within a source, then the plain mean over sources. strict: metrics that are NULL if any source's is (AGG14)."""
    per = rows.groupBy(*keys, source).agg(*[F.avg(c).alias(k) for k, c in metrics.items()])
    return per.groupBy(*keys).agg(F.count("*").alias("source_count"), *[(F.when(F.count(k) == F.count("*"), F.avg(k)) if k in strict else F.avg(k)).alias(k) for k in metrics])


def summarize_settings(scores: DataFrame, *, check: bool = True) -> DataFrame:
    """AGG2-3: penalised risks and their parts, equal weight to sources. A source without evaluable queries raises."""
    ok, can = F.col("feasible"), F.col("feasible").isNotNull()
    parts = {"feasible_rate": ok.cast("double"), "evidence_recall": F.col("evidence_recall"), "candidates_scored": F.col("candidates_scored").cast("double"), "infeasibility_risk_component": (~ok).cast("double")}
    for name in ("non_usable", "admissibility"):
        upper, known = F.col(f"{name}_upper_bound"), F.col(f"{name}_known_rate")
        parts |= {
            f"penalized_{name}_upper_risk": penalized(ok, upper), f"penalized_{name}_known_risk": penalized(ok, known),
            f"{name}_conditional_risk_component": F.when(can, F.when(ok, F.coalesce(upper, F.lit(1.0))).otherwise(F.lit(0.0))),
            f"conditional_{name}_upper_risk": F.when(ok, F.coalesce(upper, F.lit(1.0))),
        }
    per = scores.groupBy("setting_id", "source").agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for k, c in parts.items()])
    if check:
        per = per.withColumn("feasible_rate", F.when(F.col("feasible_rate").isNull(), F.raise_error(F.lit("a source has no evaluable query")).cast("double")).otherwise(F.col("feasible_rate")))
    return per.groupBy("setting_id").agg(F.count("*").alias("source_count"), F.sum("n").alias("query_count"), *[F.avg(k).alias(k) for k in parts])


def select_settings(summary: DataFrame, arm: str, risk: str = "admissibility") -> DataFrame:
    """AGG4: of each arm the setting with the least key (-feasible, upper, known, -recall, candidates, id)."""
    order = [F.desc("feasible_rate"), F.col(f"penalized_{risk}_upper_risk"), F.col(f"penalized_{risk}_known_risk"), F.desc("evidence_recall"), F.col("candidates_scored"), F.col("setting_id")]
    return summary.withColumn("k", F.row_number().over(Window.partitionBy(arm).orderBy(*order))).where("k = 1").drop("k")


def source_macro_costs(costs: DataFrame, keys: list[str], source: str) -> DataFrame:
    """AGG5: what a route costs: query means within a source, then over sources. costs: returned, candidates_scored, route_width."""
    return nested_macro(costs, keys, source, {c: F.col(c).cast("double") for c in ("returned", "candidates_scored", "route_width")})


def gap_closed(base: Column, risk: Column, oracle: Column) -> Column:
    """AGG12: the share of the way from base to oracle; NULL where there is none."""
    return F.when(base > oracle, (base - risk) / (base - oracle))


def depths(rankings: DataFrame, at: list[int]) -> DataFrame:
    """AGG6: nested prefixes of one ranking as settings `<id>@<depth>`; ranked once, at the greatest depth."""
    return rankings.where(F.col("rank") <= max(at)).withColumn("top_k", F.explode(F.array(*map(F.lit, at)))).where(F.col("rank") <= F.col("top_k")).withColumn("setting_id", F.concat_ws("@", "setting_id", "top_k"))


def leave_one_out(rows: DataFrame, value: str, keys: list[str] | None = None, out: str = "loo") -> DataFrame:
    """AGG7, STA12: the mean of the others, from totals."""
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    return rows.withColumn(out, rate(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))


def seed_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """AGG9: mean and sample deviation over seeds; one seed has deviation 0."""
    return rows.groupBy(*keys).agg(F.count("*").alias("seeds"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in metrics])


def paired_groups(rows: DataFrame, arm: str, treated: str, base: str, group: list[str], value: str) -> DataFrame:
    """AGG10: the arms' difference of group means, the group's rows, and the difference's leave-one-out mean."""
    per = rows.where(F.col(arm).isin(treated, base)).groupBy(*group).pivot(arm, [treated, base]).agg(F.avg(value))
    delta = per.select(*group, (F.col(treated) - F.col(base)).alias("delta")).where("delta IS NOT NULL")
    return leave_one_out(delta, "delta")


#: A control score's sums: over all queries, and over those that reach the target.
OF_ALL = {"evidence_recall": "evidence_recall", "feasible_rate": "feasible", "penalized_admissibility_upper_risk": "penalized_full", "penalized_residual_upper_risk": "penalized_residual", "returned_wrong_scope_rate": "returned_wrong_scope", "mean_route_width": "route_width", "mean_candidates_scored": "candidates_scored"}
OF_MATCHED = {"conditional_admissibility_upper_risk": "full_upper", "conditional_residual_upper_risk": "residual_upper", "matched_prefix_wrong_scope_rate": "matched_wrong_scope", "matched_prefix_any_known_admissibility_violation_rate": "any_known_violation", "matched_prefix_mean_known_admissibility_violation_count": "known_violations", "matched_prefix_mean_upper_admissibility_violation_count": "upper_violations"}


def states(scores: DataFrame, keys: list[str]) -> DataFrame:
    """AGG7: sums and counts by keys, which can be added (`merged`) and subtracted (`loo_source_macro`): query_count, matched_count and a sum a metric."""
    ok = F.col("feasible")
    sums = [F.sum(F.col(c).cast("double")).alias(m) for m, c in OF_ALL.items()] + [F.coalesce(F.sum(F.when(ok, F.col(c).cast("double"))), F.lit(0.0)).alias(m) for m, c in OF_MATCHED.items()]
    return scores.groupBy(*keys).agg(F.count("*").alias("query_count"), F.count_if(ok).alias("matched_count"), *sums)


def merged(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("query_count", "matched_count", *OF_ALL, *OF_MATCHED)])


def means(state: DataFrame) -> DataFrame:
    """A state's metrics; those of the queries that reach the target are NULL without any."""
    return state.withColumns({**{m: rate(F.col(m), F.col("query_count")) for m in OF_ALL}, **{m: rate(F.col(m), F.col("matched_count")) for m in OF_MATCHED}})


def state_macro(state: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Means by source, then over the sources that have one; counts are summed."""
    per = means(merged(state, [*keys, source]))
    return per.groupBy(*keys).agg(F.sum("query_count").alias("query_count"), F.sum("matched_count").alias("matched_query_count"), *[F.avg(m).alias(m) for m in (*OF_ALL, *OF_MATCHED)])


def loo_source_macro(state: DataFrame, arm: str, treated: str, base: str, source: str, group: str, metrics: list[str], *, strict: bool = True) -> DataFrame:
    """AGG7, AGG10: the arms' difference of source macros with each (source, group) left out once.

    state: a row an arm, source and group. Nothing is aggregated again: what is left of a source is its total
    less the group's state. metric, omitted source and group, group_delta (the arms' difference within the
    group), estimate (nothing left out) and loo. A source of one group raises, for leaving that out would empty it; or its loo is NULL, without `strict`.
    """
    sides = {"t": treated, "b": base}
    per = state.groupBy(source, group).agg(*[F.sum(F.when(F.col(arm) == a, F.col(c))).alias(f"{k}_{c}") for k, a in sides.items() for c in ("query_count", *metrics)])
    totals = per.groupBy(source).agg(F.count("*").alias("groups"), *[F.sum(f"{k}_{c}").alias(f"{k}_{c}_all") for k in sides for c in ("query_count", *metrics)])  # a row a source

    def of(k: str, m: str, kind: str) -> Column:
        own, every = (lambda c: F.col(f"{k}_{c}")), (lambda c: F.col(f"{k}_{c}_all"))
        return rate(own(m), own("query_count")) if kind == "group" else rate(every(m), every("query_count")) if kind == "all" else rate(every(m) - own(m), every("query_count") - own("query_count"))

    def delta(m: str, kind: str) -> Column:
        return of("t", m, kind) - of("b", m, kind)

    whole = totals.agg(F.count("*").alias("sources"), *[F.sum(delta(m, "all")).alias(f"{m}_sum") for m in metrics])  # one row
    rows = per.join(totals, source).crossJoin(F.broadcast(whole))
    several = F.when(F.col("groups") > 1, F.col("sources"))
    several = several.otherwise(F.raise_error(F.lit("leaving out a source's only group would empty it")).cast("bigint")) if strict else several
    parts = [F.struct(F.lit(m).alias("metric"), delta(m, "group").alias("group_delta"), rate(F.col(f"{m}_sum"), F.col("sources")).alias("estimate"), rate(F.col(f"{m}_sum") - delta(m, "all") + delta(m, "left"), several).alias("loo")) for m in metrics]
    return rows.select(source, group, F.explode(F.array(*parts)).alias("x")).select(source, group, "x.*")


def loo_table(loo: DataFrame) -> DataFrame:
    """A row a metric: estimate, the range of the macros with a group left out, and the groups' signs."""
    d = F.col("group_delta")
    return loo.groupBy("metric").agg(F.max("estimate").alias("estimate"), F.min("loo").alias("loo_min"), F.max("loo").alias("loo_max"), F.count("*").alias("group_count"), F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("negative"))


def sign_counts(deltas: DataFrame, value: str = "delta") -> DataFrame:
    d = F.col(value)
    return deltas.agg(F.count("*").alias("groups"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("negative"), F.min("loo").alias("loo_min"), F.max("loo").alias("loo_max"))


def with_macro_row(per: DataFrame, keys: list[str], level: str, name: str, metrics: list[str], *, strict: bool = False) -> DataFrame:
    """AGG12-14: the strata's rows and one more with the mean of their means; not a rollup, which would pool rows. strict (AGG14): NULL if any stratum's is."""
    mean = (lambda m: F.when(F.count(m) == F.count("*"), F.avg(m))) if strict else F.avg
    macro = per.groupBy(*[k for k in keys if k != level]).agg(*[mean(m).alias(m) for m in metrics]).withColumn(level, F.lit(name))
    return per.select(*keys, *metrics).unionByName(macro.select(*keys, *metrics))


def grouping_sets(rows: DataFrame, sets: list[list[str]], aggregates: dict[str, Column], *, every: str = "all") -> DataFrame:
    """AGG15-19: one pass over rows for several groupings; what a grouping leaves out reads `every`."""
    names = list(dict.fromkeys(x for s in sets for x in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*[F.grouping(c).alias(f"__{c}") for c in names], *[c.alias(k) for k, c in aggregates.items()])
    return out.select(*[F.when(F.col(f"__{c}") == 1, F.lit(every)).otherwise(F.col(c).cast("string")).alias(c) for c in names], *aggregates)


def population(rows: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """AGG20: exact median, selected by ranges."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.countDistinct(group).alias("groups"), F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))
    median = ranges.counted(rows, keys, value).groupBy(*keys).agg(ranges.interpolated(value, 0.5).alias("median"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = per.alias("a").join(median.alias("b"), same, "left")
    return out.select(*[f"a.{k}" for k in keys], "n", "mean", "median", "low", "high", "groups", "coverage")


def quantiles(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """AGG21, AGG22, AGG28: the three conventions side by side: interpolated, floor((n-1)p), and round((n-1)p) to even; selected by ranges."""
    at = (F.col("n_total") - 1) * p
    return ranges.counted(rows, keys, value).groupBy(*keys).agg(ranges.interpolated(value, p).alias("interpolated"), ranges.at_rank(value, F.floor(at)).alias("floored"), ranges.at_rank(value, F.rint(at)).alias("rounded"))


def usage(calls: DataFrame, keys: list[str], sums: dict[str, str], latency: str) -> DataFrame:
    """AGG21, AGG28: calls, the sums (attempts, tokens, cost; NULL counts as none), and the latency's median and 95 % quantile by rounded places."""
    at = {f"{latency}_p{p}": (F.col("n_total") - 1) * p / 100 for p in (50, 95)}
    per = calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])
    found = ranges.counted(calls, keys, latency).groupBy(*keys).agg(*[ranges.at_rank(latency, F.rint(x)).alias(k) for k, x in at.items()])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return per.alias("a").join(found.alias("b"), same, "left").select(*[f"a.{k}" for k in keys], "calls", *sums, *at)


def duplicate_calls(rows: DataFrame, case: str, payload: str, cost: str) -> DataFrame:
    """AGG24: cases called more than once, whether their answers differ, and the cost beyond the first."""
    per = rows.groupBy(case).agg(F.count("*").alias("calls"), F.countDistinct(F.sha2(payload, 256)).alias("answers"), F.sum(cost).alias("cost"), F.max(cost).alias("most"))
    return per.where("calls > 1").select(case, "calls", "answers", (F.col("answers") > 1).alias("differs"), "cost", (F.col("cost") - F.col("most")).alias("repeat_cost"))


def gate(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """AGG25: any and all of several conditions."""
    return rows.agg(*[f(c).alias(f"{how}_{k}") for k, c in conditions.items() for how, f in (("any", F.bool_or), ("all", F.bool_and))])


def running_counts(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """AGG26: how many rows lie at or below each bucket."""
    per = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    return per.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)))
