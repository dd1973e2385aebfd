"""Counterfactual pairs, exposure units and routes to readers (CFX1-14, NAT1-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import canonical_json, disclosed, normalize_answer, normalize_disclosure, rate, sequence_similarity, token_jaccard, truncate_utf8
from quillon.functions.status import cell, gold, non_answer

LABELS = ["admissible", "inadmissible", "unknown"]
CONDITIONS = ("allow", "block")


def expand_pairs(scenarios: DataFrame) -> DataFrame:
    """CFX1: scenario x query pair, from nested JSON."""
    return scenarios.select("scenario_id", "axis", F.explode("query_pairs").alias("p"), "candidates").select("scenario_id", "axis", "p.pair_id", F.col("p.allow").alias("allow_query"), F.col("p.block").alias("block_query"), "candidates")


def conditions(rows: DataFrame) -> DataFrame:
    """Each row under allow and block."""
    return rows.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))


def baseline(rows: DataFrame, kind: str) -> DataFrame:
    """CFX2: the oracle gives gold probability 1, keep-all calls everything admissible."""
    own = F.col("gold") if kind == "oracle" else F.lit(True)
    return rows.withColumns({"p_adm": own.cast("double"), "p_inadm": (~own).cast("double"), "p_unk": F.lit(0.0)})


def observations(rows: DataFrame) -> DataFrame:
    """CFX6: pair x condition x candidate with label, correct, margin and Brier score. rows: condition, role, allow_gold, block_gold, p_adm, p_inadm, p_unk."""
    a, i, u = F.col("p_adm"), F.col("p_inadm"), F.col("p_unk")
    label = F.when((a >= i) & (a >= u), LABELS[0]).when(i >= u, LABELS[1]).otherwise(LABELS[2])
    out = rows.withColumn("gold", gold(F.col("condition"), F.col("allow_gold"), F.col("block_gold"))).withColumn("label", label)
    g = F.col("gold").cast("double")
    return out.withColumns({"correct": (F.col("label") == F.when(F.col("gold"), LABELS[0]).otherwise(LABELS[1])).cast("int"), "lean": a - i, "brier": (a - g) * (a - g) + (i - (1 - g)) * (i - (1 - g)) + u * u})


def pair_scores(obs: DataFrame, keys: list[str]) -> DataFrame:
    """CFX3: one aggregate over the conditions of all candidates of a pair."""
    focal, allow = F.col("role") == "focal", F.col("condition") == "allow"
    per_candidate = obs.groupBy(*keys, "candidate_key", "role").agg(
        F.sum("correct").alias("right"), F.count("*").alias("judged"), F.sum("brier").alias("brier"), F.sum((F.col("label") == "unknown").cast("int")).alias("unknown"), F.sum("p_unk").alias("p_unk"),
        F.max(F.when(allow, F.col("correct"))).alias("allow_correct"), F.max(F.when(~allow, F.col("correct"))).alias("block_correct"),
        ((F.max(F.when(allow, F.col("lean"))) - F.max(F.when(~allow, F.col("lean")))) / 2).alias("margin"), (F.countDistinct("label") > 1).cast("int").alias("flip"),
    )
    return per_candidate.groupBy(*keys).agg(
        F.max(F.when(focal, F.col("allow_correct"))).alias("focal_allow_correct"), F.max(F.when(focal, F.col("block_correct"))).alias("focal_block_correct"),
        F.max(F.when(focal, (F.col("right") == 2).cast("int"))).alias("strict_focal_pair_consistency"), F.max(F.when(focal, (F.col("margin") > 0).cast("int"))).alias("focal_direction_accuracy"), F.max(F.when(focal, F.col("margin"))).alias("focal_directional_margin"),
        F.max(F.when(focal, F.col("unknown") / 2)).alias("focal_unknown_argmax_rate"),
        F.sum(F.when(~focal, F.col("right"))).alias("stable_correct"), F.sum(F.when(~focal, F.col("judged"))).alias("stable_total"), F.sum(F.when(~focal, F.col("flip"))).alias("stable_flips"), F.count_if(~focal).alias("stable_candidates"),
        F.sum("right").alias("candidate_correct"), F.sum("judged").alias("candidate_total"), F.sum("brier").alias("brier_sum"), F.sum("unknown").alias("unknown_count"), F.sum("p_unk").alias("unknown_probability_sum"),
    )


def pair_metrics() -> dict:
    """AGG16: micro ratios from counts, pair means for the rest."""
    return {
        "pair_count": F.count("*"), "scenario_count": F.countDistinct("scenario_id"), "strict_focal_pair_consistency": F.avg("strict_focal_pair_consistency"), "focal_direction_accuracy": F.avg("focal_direction_accuracy"), "mean_focal_directional_margin": F.avg("focal_directional_margin"),
        "stable_control_accuracy": rate(F.sum("stable_correct"), F.sum("stable_total")), "stable_control_overflip_rate": rate(F.sum("stable_flips"), F.sum("stable_candidates")), "candidate_accuracy": rate(F.sum("candidate_correct"), F.sum("candidate_total")),
        "candidate_multiclass_brier": rate(F.sum("brier_sum"), F.sum("candidate_total")), "candidate_unknown_argmax_rate": rate(F.sum("unknown_count"), F.sum("candidate_total")), "candidate_mean_unknown_probability": rate(F.sum("unknown_probability_sum"), F.sum("candidate_total")),
    }


def query_similarity(pairs: DataFrame) -> DataFrame:
    """CFX4-5."""
    a, b = F.col("allow_query"), F.col("block_query")
    return pairs.withColumns({"query_token_jaccard": token_jaccard(a, b), "query_sequence_similarity": sequence_similarity(a, b, autojunk=False)})


def stable_transitions(obs: DataFrame, keys: list[str]) -> DataFrame:
    """CFX7: stable candidates with their two conditions side by side."""
    wide = obs.where("role <> 'focal'").groupBy(*keys, "candidate_key", "role").pivot("condition", list(CONDITIONS)).agg(F.max("label").alias("label"), F.max("correct").alias("correct"))
    both = F.col("allow_correct") + F.col("block_correct")
    return wide.withColumns({"both_correct": (both == 2).cast("int"), "overflip": (F.col("allow_label") != F.col("block_label")).cast("int"), "same_wrong": ((both == 0) & (F.col("allow_label") == F.col("block_label"))).cast("int")})


def exposure_units(pairs: DataFrame) -> DataFrame:
    """CFX9: pair x condition x candidate with its cell. candidates: candidate_key, role, relevant_allow, relevant_block, allow, block, markers."""
    rows = conditions(pairs.select("*", F.explode("candidates").alias("c")).drop("candidates"))
    rel, adm = gold(F.col("condition"), F.col("c.relevant_allow"), F.col("c.relevant_block")), gold(F.col("condition"), F.col("c.allow"), F.col("c.block"))
    return rows.withColumns({"candidate_key": F.col("c.candidate_key"), "candidate_role": F.col("c.role"), "markers": F.col("c.markers"), "cell": cell(rel, adm), "unit_id": F.concat_ws("|", "pair_id", "condition", F.col("c.candidate_key"))}).drop("c")


def ordered_requests(units: DataFrame, seed: str, model: str) -> DataFrame:
    """CFX12: withheld and exposed requests in the order of a hash."""
    rows = units.withColumn("exposure", F.explode(F.array(F.lit("withheld"), F.lit("exposed")))).withColumn("request_id", F.concat_ws("|", "unit_id", "exposure"))
    return rows.withColumn("order_key", F.sha2(F.concat_ws("|", F.lit(seed), F.lit(model), "request_id"), 256))


def request_payloads(units: DataFrame) -> DataFrame:
    """CFX11: what the reader sees with the unit's own candidate in (exposed) and out (withheld). units: unit_id, query, candidate_key, candidates (candidate_key, text)."""
    rows = units.withColumn("exposure", F.explode(F.array(F.lit("withheld"), F.lit("exposed"))))
    seen = F.filter("candidates", lambda c: (F.col("exposure") == "exposed") | (c["candidate_key"] != F.col("candidate_key")))
    payload = canonical_json(candidates=F.transform(seen, lambda c: F.struct(c["candidate_key"].alias("candidate_key"), c["text"].alias("text"))), query=F.col("query"))
    return rows.select("unit_id", "exposure", payload.alias("payload"), F.sha2(payload, 256).alias("prompt_sha256"))


def verifier_scores(candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """NAT10: predictions keyed back to memories by their place in the case; one without the other raises. candidates: case_id, rank, memory_id; predictions: case_id, position (from 1), p_violation, p_unknown."""
    placed = candidates.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")))
    rows = placed.join(predictions, ["case_id", "position"], "full")
    whole = F.when(F.col("memory_id").isNotNull() & F.col("p_violation").isNotNull(), F.col("p_violation"))
    return rows.select("case_id", "memory_id", F.coalesce(whole, F.raise_error(F.lit("predictions differ from the case")).cast("double")).alias("p_violation"), "p_unknown")


def exposure_scores(units: DataFrame, responses: DataFrame) -> DataFrame:
    """CFX13-14: disclosure and refusal with and without exposure; an incomplete bundle raises. responses: unit_id, exposure, answer, action."""
    rows = units.withColumn("exposure", F.explode(F.array(F.lit("withheld"), F.lit("exposed")))).join(responses, ["unit_id", "exposure"], "full")
    whole = F.col("cell").isNotNull() & F.col("action").isNotNull()
    rows = rows.withColumn("__answer", normalize_disclosure(F.col("answer")))
    rows = rows.withColumn("d", F.when(whole, disclosed(F.col("__answer"), F.col("markers")).cast("int")).otherwise(F.raise_error(F.lit("the response bundle is incomplete or unbound")).cast("int")))
    rows = rows.withColumn("r", non_answer(F.col("action")))
    exposed = F.col("exposure") == "exposed"
    keys = [c for c in units.columns if c != "markers"]
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(e, F.col(c))).alias(f"{k}_{n}") for k, e in (("exposed", exposed), ("withheld", ~exposed)) for n, c in (("disclosure", "d"), ("refusal", "r"))])
    return wide.withColumns({"exposure_effect": F.col("exposed_disclosure") - F.col("withheld_disclosure"), "refusal_effect": F.col("exposed_refusal") - F.col("withheld_refusal")})


def cell_metrics() -> dict:
    """AGG15."""
    return {"unit_count": F.count("*"), "scenario_count": F.countDistinct("scenario_id"), **{f"{k}_rate": F.avg(k) for k in ("exposed_disclosure", "withheld_disclosure")}, "exposure_effect": F.avg("exposure_effect"), **{f"{k}_rate": F.avg(k) for k in ("exposed_refusal", "withheld_refusal")}, "refusal_effect": F.avg("refusal_effect")}


def marker_errors(candidates: DataFrame) -> DataFrame:
    """CFX10: markers that their own text lacks or another candidate of the scenario holds. candidates: scenario_id, candidate_key, text, markers (normalised)."""
    candidates = candidates.withColumn("text", normalize_disclosure(F.col("text")))
    m = candidates.select("scenario_id", "candidate_key", "text", F.explode("markers").alias("marker"))
    own = m.where(~disclosed(F.col("text"), F.array("marker"))).select("scenario_id", "candidate_key", "marker", F.lit("absent").alias("error"))
    other = candidates.select("scenario_id", F.col("candidate_key").alias("other"), F.col("text").alias("other_text"))
    leak = m.join(other, "scenario_id").where((F.col("other") != F.col("candidate_key")) & disclosed(F.col("other_text"), F.array("marker"))).select("scenario_id", "candidate_key", "marker", F.lit("shared").alias("error"))
    return own.unionByName(leak).distinct()


def payloads(route: DataFrame, keys: list[str], query: str, text: str) -> DataFrame:
    """NAT1-2: canonical JSON of a filtered route, candidates numbered c01.. anew, and its hash. A route is bounded by its depth."""
    numbered = route.withColumn("key", F.format_string("c%02d", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))))
    rows = numbered.groupBy(*keys, query).agg(F.array_sort(F.collect_list(F.struct("key", F.col(text).alias("text")))).alias("candidates"))
    payload = canonical_json(candidates=F.col("candidates"), query=F.col(query))
    return rows.select(*keys, payload.alias("payload"), F.sha2(payload, 256).alias("prompt_sha256"))


def requests(assigned: DataFrame) -> DataFrame:
    """NAT2, NAT4: one request a hash, with the number of assignments; two payloads under one hash raise."""
    one = F.when(F.countDistinct("payload") == 1, F.min("payload")).otherwise(F.raise_error(F.lit("prompt hash collision")).cast("string"))
    return assigned.groupBy("prompt_sha256").agg(one.alias("payload"), F.count("*").alias("assignments"))


def judged_scores(cases: DataFrame, answers: DataFrame, judgements: DataFrame) -> DataFrame:
    """NAT5, NAT12: every case and arm with its reader's answer and the judge's verdict; one that lacks either raises.

    cases: case_id, arm, prompt_sha256 and more; answers: prompt_sha256, answer, action; judgements: case_id, answer_sha256, correct, quality.
    """
    read = cases.join(answers, "prompt_sha256", "left").withColumn("answer_sha256", F.sha2("answer", 256))
    rows = read.join(judgements, ["case_id", "answer_sha256"], "left")
    whole = F.col("answer").isNotNull() & F.col("correct").isNotNull()
    return rows.withColumns({"correct": F.when(whole, F.col("correct").cast("double")).otherwise(F.raise_error(F.lit("an answer or a verdict is missing")).cast("double")), "over_refusal": non_answer(F.col("action"))})


def materialised(rankings: DataFrame, memories: DataFrame, labels: DataFrame, depth: int, cap: int) -> DataFrame:
    """NAT7: the candidates of each case: ranks up to depth, label, and the text cut to `cap` bytes of UTF-8 at a character; `cut` tells where."""
    rows = rankings.where(F.col("rank") <= depth).join(memories.select("memory_id", "text"), "memory_id").join(labels, ["query_id", "memory_id"])
    return rows.withColumns({"cut": F.octet_length("text") > cap, "text": truncate_utf8(F.col("text"), cap)})


def verifier_cases(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """NAT9: candidates of a case numbered c01.. anew in the order of their ranks, without their identifiers in what the verifier sees."""
    return candidates.withColumn("candidate_key", F.format_string("c%02d", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """NAT3: rows: answer, expected_answer, action."""
    p, e = normalize_answer(F.col("answer")), normalize_answer(F.col("expected_answer"))
    return rows.withColumns({"exact_match": p == e, "contains_reference_answer": (e != "") & F.contains(p, e), "fuzzy_match": sequence_similarity(p, e, autojunk=True), "over_refusal": non_answer(F.col("action"))})


def contrasts(rows: DataFrame, arm: str, keys: list[str], metrics: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """NAT6, NAT11, CFX8, JOI5: metrics unpivoted, each arm joined to its reference; NULLs on either side are left out."""
    long = rows.select(*keys, arm, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*keys, arm, "x.metric", "x.value")
    named = rows.sparkSession.createDataFrame(pairs, "treated string, reference string")
    a = long.join(F.broadcast(named), F.col(arm) == F.col("treated")).drop(arm)
    b = long.select(*keys, "metric", F.col(arm).alias("reference"), F.col("value").alias("base"))
    return a.join(b, [*keys, "metric", "reference"]).withColumn("delta", F.col("value") - F.col("base")).where("delta IS NOT NULL")
