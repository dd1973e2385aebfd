"""Operators against hand-computed values and plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.functions import scalar, status
from quillon.operators import aggregate, arms, cells, classify, cluster, corrupt, corrupt_grid, paired, prefix, quality, ranges, rank, stats, support
from quillon.plans import retrieval
from quillon.sources import io

PAIRS = "query_id bigint, source string, group_id string, namespace string, intent string, purpose string, memory_id bigint, memory_namespace string, lifecycle_state string, content_allowed boolean, trace_allowed boolean, released_order double, q_embedding array<double>, m_embedding array<double>"
# Memories 1-4 of the first query and 5-7 of the second.
ROWS = [
    (1, "rhelm", "g", "a", "current_state", "content_disclosure", 1, "a", "current", None, None, 3.0, [1.0, 0.0], [1.0, 0.0]),
    (1, "rhelm", "g", "a", "current_state", "content_disclosure", 2, "a", "stale", None, None, 1.0, [1.0, 0.0], [0.995037, 0.099504]),
    (1, "rhelm", "g", "a", "current_state", "content_disclosure", 3, "b", "current", None, None, 2.0, [1.0, 0.0], [1.0, 0.0]),
    (1, "rhelm", "g", "a", "current_state", "content_disclosure", 4, "a", "current", False, True, 4.0, [1.0, 0.0], [0.948683, 0.316228]),
    (2, "memops", "g", "p", "history", "content_disclosure", 5, "p", "current", None, None, 2.0, [0.0, 1.0], [0.0, 1.0]),
    (2, "memops", "g", "p", "history", "content_disclosure", 6, "p", "superseded", None, None, 1.0, [0.0, 1.0], [0.099504, 0.995037]),
    (2, "memops", "g", "p", "history", "content_disclosure", 7, "x", "current", None, None, 1.0, [0.0, 1.0], [0.0, 1.0]),
]
LABELS = [(1, 1, True, True, True, True), (1, 2, False, True, True, False), (1, 3, False, False, True, True), (1, 4, True, True, False, True), (2, 5, True, True, True, True), (2, 6, True, True, True, True), (2, 7, False, False, True, True)]
LABEL_SCHEMA = "query_id bigint, memory_id bigint, relevant boolean, scope_ok boolean, policy_ok boolean, lifecycle_ok boolean"


def test_two_cases_under_all_dense_arms(spark):
    pairs, labels = spark.createDataFrame(ROWS, PAIRS), spark.createDataFrame(LABELS, LABEL_SCHEMA)
    names = list(arms.DENSE)
    ranked = arms.dense_arms(pairs, names)
    got = {(r["setting_id"], r["query_id"]): r["ids"] for r in ranked.groupBy("setting_id", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("ids")).collect()}
    assert got[("global_dense", 1)] == [1, 3, 2, 4] and got[("global_dense", 2)] == [5, 7, 6]
    assert got[("namespace_dense", 1)] == [1, 2, 4] and got[("namespace_policy_only", 1)] == [1, 2]
    assert got[("query_agnostic_current_only", 1)] == [1, 4] and got[("query_agnostic_current_only", 2)] == [5]
    assert got[("released_governance_oracle_v2", 1)] == [1] and got[("released_intent_lifecycle_upper_bound", 2)] == [5, 6]
    scores = prefix.score_route(ranked, labels, arms.route_stats(pairs, names), 0.8)
    summary = {r["setting_id"]: r for r in aggregate.summarize_settings(scores).collect()}
    want = {"global_dense": (3.5, 1.0, 1 / 6), "namespace_dense": (2.5, 1.0, 0.0), "query_agnostic_current_only": (1.5, 0.5, 0.5), "namespace_policy_only": (2.0, 1.0, 0.0), "namespace_lifecycle_only": (2.0, 1.0, 0.0), "released_governance_oracle_v2": (1.5, 1.0, 0.0)}
    for k, (candidates, feasible, risk) in want.items():
        r = summary[k]
        assert (r["candidates_scored"], r["feasible_rate"]) == (candidates, feasible) and r["penalized_admissibility_upper_risk"] == pytest.approx(risk)
        assert r["penalized_admissibility_upper_risk"] == pytest.approx(r["infeasibility_risk_component"] + r["admissibility_conditional_risk_component"])


def test_unknown_labels_widen_the_bounds(spark):
    labels = spark.createDataFrame([(1, 1, None, True, None, True), (1, 2, False, False, True, True), (1, 3, True, True, True, True)], LABEL_SCHEMA)
    ranked = spark.createDataFrame([("s", 1, i, i) for i in (1, 2, 3)], "setting_id string, query_id bigint, memory_id bigint, rank int")
    runs = spark.createDataFrame([("s", "x", "g", 1, 3, 1), ("s", "x", "g", 2, 0, 0)], "setting_id string, source string, group_id string, query_id bigint, candidates_scored bigint, route_width int")
    one, none = sorted(prefix.score_route(ranked, labels, runs, 1.0).collect(), key=lambda r: r["query_id"])
    assert one["matched_prefix_count"] == 3 and one["admissibility_lower_bound"] == pytest.approx(1 / 3) and one["admissibility_upper_bound"] == pytest.approx(2 / 3) and one["admissibility_known_rate"] == 0.5
    assert none["evidence_recall"] is None and none["feasible"] is None and none["matched_prefix_count"] is None


def test_filter_and_cut_do_not_commute(spark):
    pairs = spark.createDataFrame(ROWS[:4], PAIRS)
    post = arms.post_filters(arms.dense_arm(pairs, "global_dense", 4), [2, 4], 20)
    assert {(r["depth"], r["memory_id"], r["rank"]) for r in post.collect()} == {(2, 1, 1), (4, 1, 1), (4, 2, 2), (4, 4, 3)}
    ranked = rank.top_k(rank.dense(pairs), None)
    assert support.filter_ranking(ranked, support.in_namespace(), ["query_id"], 0).count() == 3
    assert rank.top_k(rank.recency(pairs, 10.0), 1).first()["memory_id"] == 4


def test_bm25_ranks_by_terms(spark):
    m = spark.createDataFrame([(1, "unrelated words"), (2, "target target evidence"), (3, None)], "memory_id bigint, text string")
    q = spark.createDataFrame([(9, "target evidence")], "query_id bigint, text string")
    got = rank.top_k(rank.bm25(q, m.where("text IS NOT NULL"), q.select("query_id").crossJoin(m.where("text IS NOT NULL").select("memory_id"))), None).collect()
    assert [r["memory_id"] for r in got] == [2, 1] and got[1]["score"] == 0


def test_routers(spark):
    m = spark.createDataFrame([("a", 1, 1.0, [1.0, 0.0]), ("a", 2, 2.0, [0.99, 0.141067]), ("b", 3, 3.0, [0.0, 1.0])], "memory_namespace string, memory_id bigint, released_order double, m_embedding array<double>")
    pairs = m.selectExpr("9L AS query_id", "'a' AS namespace", "array(0D, 1D) AS q_embedding", "memory_id", "memory_namespace", "m_embedding")
    got = arms.threshold_router(pairs, m, theta=0.9, top_l=3).collect()
    assert {r["memory_id"] for r in got} == {1, 2} and all(r["fallback_used"] for r in got)
    members, _ = cluster.clusters(m, cluster.size_aware_rule(alpha=1, beta=1, gamma=0.5, tau=0.1, tau_new=0.4))
    assert {(r["memory_id"], r["cluster"]) for r in members.collect()} == {(1, 0), (2, 0), (3, 0)}


def test_status_logic(spark):
    rows = spark.createDataFrame([("current", "unknown"), ("stale", "history"), ("stale", "current_state"), ("unknown", "history"), ("current", "current_state")], "s string, i string")
    assert [r[0] for r in rows.select(status.lifecycle_compatible(F.col("s"), F.col("i"))).collect()] == [None, True, False, None, True]
    pen = spark.createDataFrame([(None, 0.5), (True, 0.5), (True, None), (False, None)], "f boolean, v double")
    assert [r[0] for r in pen.select(status.penalized(F.col("f"), F.col("v"))).collect()] == [None, 0.5, 1.0, 1.0]


def test_corruption_is_nested_and_spares_labels(spark):
    pairs = spark.createDataFrame(ROWS, PAIRS).withColumn("truth", F.lit("kept"))
    rows = corrupt.corrupt(pairs, corrupt.grid(spark, list(corrupt.CHANNELS), [0.0, 0.2, 0.6, 1.0], [1, 2]), corrupt.vocabulary(pairs, pairs))
    hits = {}
    for r in rows.collect():
        assert r["truth"] == "kept"
        hits.setdefault((r["channel"], r["seed"], r["rate"]), set()).update([(r["query_id"], r["memory_id"])] if r["hit"] else [])
    for c in corrupt.CHANNELS:
        for s in (1, 2):
            low, mid, high, all_ = (hits[(c, s, x)] for x in (0.0, 0.2, 0.6, 1.0))
            assert not low and mid <= high <= all_ and len(all_) == 7
    curve = spark.createDataFrame([("c", r, v, 0.3) for r, v in ((0.0, 0.1), (0.1, 0.2), (0.2, 0.5), (0.3, 0.1))], "channel string, rate double, value double, base double")
    assert tuple(corrupt.break_even(curve, ["channel"], "value", "base").first()) == ("c", 0.1, 0.2)


def _corruptible(spark, n=70, dims=4):
    """Memories of four namespaces, every fifth a query, with odd policies and states; labels by identifier."""
    rng = np.random.default_rng(11)
    state, flag = ["current", "stale", "superseded", "unknown"], [True, False, None]
    rows = [(i, "abcd"[int(rng.integers(4))], state[int(rng.integers(4))], flag[int(rng.integers(3))], flag[int(rng.integers(3))], float(i), [float(x) for x in rng.integers(-2, 3, dims)]) for i in range(n)]
    memories = spark.createDataFrame(rows, "memory_id bigint, memory_namespace string, lifecycle_state string, content_allowed boolean, trace_allowed boolean, released_order double, m_embedding array<double>")
    asked = [(f"s{i % 2}", f"g{i % 3}", i, ns, ["current_state", "history", "unknown"][i // 5 % 3], ["content_disclosure", "operation_trace"][i // 5 % 2], v) for i, ns, _, _, _, _, v in rows if i % 5 == 0]
    queries = spark.createDataFrame(asked, "source string, group_id string, query_id bigint, namespace string, intent string, purpose string, q_embedding array<double>")
    pairs = queries.join(memories, F.col("query_id") != F.col("memory_id"))
    mixed = F.pmod(F.xxhash64("query_id", "memory_id"), F.lit(7))
    labels = pairs.select("query_id", "memory_id", (mixed < 3).alias("relevant"), (F.col("namespace") == F.col("memory_namespace")).alias("scope_ok"), F.when(mixed != 2, mixed != 6).alias("policy_ok"), (mixed != 5).alias("lifecycle_ok"))
    return queries, memories, pairs, labels


@pytest.mark.parametrize(("top", "group", "slice_rows"), [(100, 64, 1 << 16), (4, 3, 4)])
def test_settings_under_a_corruption_grid(spark, top, group, slice_rows):
    """The masks against a row for each pair and corruption; the second case meets in 18 slices, narrowed twice."""
    assert len(corrupt.CHANNELS) * len(retrieval.PROTOCOL_RATES) * len(retrieval.PROTOCOL_SEEDS) == 880
    queries, memories, pairs, labels = _corruptible(spark)
    rates, seeds = [0.0, 0.4, 1.0], [0, 1]
    known = prefix.labelled(labels).cache()
    anchors = known.groupBy("query_id").agg(F.count_if(F.coalesce("usable", F.lit(False))).alias("anchor_total"))
    points = retrieval.robustness(queries, memories, lambda ranked: known.join(ranked.select("query_id", "memory_id").distinct(), ["query_id", "memory_id"], "left_semi"), anchors, rates, seeds, 0.5, top, group=group, slice_rows=slice_rows).cache()
    got = {(r["arm"], r["channel"], r["rate"], r["seed"]): [r[c] for c in retrieval.CURVE] for r in points.collect()}
    scored = corrupt.corrupt(rank.dense(pairs), corrupt.grid(spark, list(corrupt.CHANNELS), rates, seeds), corrupt.vocabulary(memories, queries))
    ranked, runs = arms.corrupted_arms(scored, retrieval.PROTOCOL_ARMS, top)
    plain = aggregate.summarize_settings(prefix.score_route(arms.dense_arms(pairs, ["global_dense"], top), labels, arms.route_stats(pairs, ["global_dense"]), 0.5)).first()
    want = {}
    for r in aggregate.summarize_settings(prefix.score_route(ranked, labels, runs, 0.5)).collect():
        arm, channel, rate, seed = r["setting_id"].split("|")
        want[arm, channel, float(rate), int(seed)] = [r[c] for c in retrieval.CURVE]
    want |= {("global_dense", c, r, s): [plain[x] for x in retrieval.CURVE] for c in corrupt.CHANNELS for r in rates for s in seeds}
    assert got.keys() == want.keys() and len(got) == 11 * 3 * 2 * 4
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k
    even = {(r["channel"], r["seed"]): (r["last_dominating_rate"], r["first_non_dominating_rate"]) for r in retrieval.dominance(points).collect()}
    assert len(even) == 22


def test_corruption_curve_counts(spark):
    queries, memories, pairs, _ = _corruptible(spark)
    rates, seeds = [0.0, 0.4, 1.0], [3]
    rows = corrupt.corrupt(pairs.withColumn("scope", F.col("namespace") != F.col("memory_namespace")), corrupt.grid(spark, list(corrupt.CHANNELS), rates, seeds), corrupt.vocabulary(memories, queries))
    admitted = F.coalesce(support.in_namespace() & support.governance_v2(), F.lit(False))
    want = rows.groupBy("channel", "rate", "seed").agg(F.count_if("hit"), F.count_if(admitted), F.count_if(admitted & F.col("scope")))
    got = corrupt_grid.curve(queries, memories, "released_governance_oracle_v2", list(corrupt.CHANNELS), rates, seeds, group=3, slice_rows=9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _corpus(spark, n=150):
    """Memories with texts of a few common and many rare words, copies among them and empty ones; every sixth is a query."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, int(rng.integers(1, 30))), 400)) for _ in range(n)]
    texts[20:40] = [texts[6]] * 20
    texts[41], texts[42], texts[48], texts[60] = "", "onlyhere", "only", ""
    vectors = [[float(x) for x in rng.integers(-3, 4, 5)] for _ in range(n)]
    rows = [(i, texts[i], vectors[i % 90], float(i % 50)) for i in range(n)]
    memories = spark.createDataFrame(rows, "memory_id bigint, text string, m_embedding array<double>, released_order double").repartition(3)
    queries = memories.where("memory_id % 6 = 0").select(F.col("memory_id").alias("query_id"), "text", F.col("m_embedding").alias("q_embedding"))
    pairs = queries.drop("text").join(memories.drop("text"), F.col("query_id") != F.col("memory_id"))
    return queries, memories, pairs


def _best(df):
    return sorted((r["query_id"], r["rank"], r["memory_id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("top", [7, 200])
def test_rankings_by_cells(spark, top):
    """Against rankings of all pairs; groups of 4 queries with slices of 20 memories."""
    queries, memories, pairs = _corpus(spark)
    small = {"group": 4, "slice_rows": 20}
    lexical = rank.bm25(queries.select("query_id", "text"), memories.select("memory_id", "text"), pairs.select("query_id", "memory_id")).withColumn("score", F.round("score", 9)).cache()
    words, vectors = cells.bm25_corpus(queries, memories, **small), cells.dense_corpus(queries, memories, **small)
    assert _best(cells.ranked(words, memories, top)) == _best(rank.top_k(lexical, top))
    assert _best(cells.ranked(cells.dense_corpus(queries, memories, 0.1, **small), memories, top)) == _best(rank.top_k(rank.recency(pairs, 0.1), top))
    if top == 7:
        for c in (0, 60):
            assert _best(cells.fused(words, vectors, memories, top, c)) == _best(rank.top_k(rank.rrf(lexical, rank.dense(pairs), c), top))


def test_matched_recall_keeps_runs_without_rows(spark):
    """A query with anchors whose ranking is empty has recall 0 and pays the cost."""
    statuses = spark.createDataFrame([(1, 10, True, True, None, False), (1, 11, False, False, False, True)], "query_id bigint, memory_id bigint, anchor boolean, full boolean, residual boolean, wrong_scope boolean")
    rankings = spark.createDataFrame([("a", 1, 11, 1), ("a", 1, 10, 2)], "setting_id string, query_id bigint, memory_id bigint, rank int")
    runs = spark.createDataFrame([(s, q, 2) for s in "ab" for q in (1, 2)], "setting_id string, query_id bigint, anchor_total bigint")
    grid = spark.createDataFrame([(0.5, 0.25), (0.8, 1.0)], "target double, cost double")
    got = {(r["setting_id"], r["query_id"], r["target"]): r for r in prefix.score_matched_recall(rankings, statuses, runs, grid).collect()}
    assert len(got) == 8
    full = got["a", 1, 0.5]
    assert (full["evidence_recall"], full["feasible"], full["penalized_full"], full["penalized_residual"], full["known_violations"], full["upper_violations"], full["returned_wrong_scope"], full["matched_wrong_scope"], full["route_width"]) == (0.5, True, 0.5, 1.0, 1, 1, 0.5, 0.5, 2)
    for key, cost in ((("a", 1, 0.8), 1.0), (("a", 2, 0.5), 0.25), (("b", 1, 0.5), 0.25), (("b", 2, 0.8), 1.0)):
        r = got[key]
        assert (r["feasible"], r["penalized_full"], r["penalized_residual"], r["full_upper"], r["known_violations"], r["matched_wrong_scope"]) == (False, cost, cost, None, None, None)
        assert r["route_width"] == (2 if key[:2] == ("a", 1) else 0)
    labels = spark.createDataFrame([(1, 10, True, True, True, True), (1, 11, True, False, True, True)], LABEL_SCHEMA)
    seen = {(r["setting_id"], r["query_id"]): tuple(r)[2:] for r in prefix.scope_diagnostics(rankings, labels, runs, 0.5).collect()}
    assert seen == {("a", 1): (2, 0.5, 0.5), ("a", 2): (0, 0.0, None), ("b", 1): (0, 0.0, None), ("b", 2): (0, 0.0, None)}


def test_leave_one_group_out_by_subtraction(spark):
    rng = np.random.default_rng(9)
    rows = [(a, s, f"{s}{g}", float(rng.random())) for s in "xyz" for g in range(3) for a in ("t", "b") for _ in range(int(rng.integers(1, 5)))]
    base = spark.createDataFrame(rows, "arm string, source string, grp string, m double")
    state = base.groupBy("arm", "source", "grp").agg(F.count("*").alias("query_count"), F.sum("m").alias("m"))
    got = aggregate.loo_source_macro(state, "arm", "t", "b", "source", "grp", ["m"]).collect()
    mean = lambda x: sum(x) / len(x)

    def macro(keep):
        return mean([mean([v for a, t, g, v in rows if a == "t" and t == s and keep(s, g)]) - mean([v for a, t, g, v in rows if a == "b" and t == s and keep(s, g)]) for s in "xyz"])

    assert len(got) == 9
    for r in got:
        assert r["estimate"] == pytest.approx(macro(lambda s, g: True))
        assert r["loo"] == pytest.approx(macro(lambda s, g, o=(r["source"], r["grp"]): (s, g) != o))
    only = state.where("source <> 'x' OR grp = 'x0'")
    with pytest.raises(Exception, match="only group"):
        aggregate.loo_source_macro(only, "arm", "t", "b", "source", "grp", ["m"]).collect()
    assert [r["loo"] for r in aggregate.loo_source_macro(only, "arm", "t", "b", "source", "grp", ["m"], strict=False).where("source = 'x'").collect()] == [None]


def test_progressive_filter_reads_less(spark):
    queries, memories, pairs = _corpus(spark)
    corpus = cells.dense_corpus(queries, memories, group=8, slice_rows=50)
    allowed = (F.col("memory_id") + F.col("query_id")) % 3 != 0
    got, steps = cells.first_supported(corpus, memories, lambda rows: rows.where(allowed), 5, 6)
    whole = support.filter_ranking(rank.top_k(rank.dense(pairs), None), allowed, ["query_id"], 5)
    assert sorted(map(tuple, got.select("query_id", "memory_id", "rank").collect())) == sorted(map(tuple, whole.select("query_id", "memory_id", "rank").collect()))
    opened = [s[1] for s in steps]
    assert opened[0] == 25 and len(steps) > 1 and opened == sorted(opened, reverse=True) and opened[-1] < 25
    assert sum(s[2] for s in steps) < 25 * 149 / 5
    none, steps = cells.first_supported(corpus, memories, lambda rows: rows.where("false"), 5, 100)
    assert none.collect() == [] and [s[2] for s in steps] == [2500, 25 * 49]


def test_selection_and_running_sums_by_ranges(spark):
    """A key of two thirds of all rows, ties, NULL keys and values; no task sorts more than a range."""
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else "cold", None if i % 97 == 0 else float(rng.integers(0, 900)) if i % 2 else 7.0, int(rng.integers(2))) for i in range(4000)] + [("one", 3.0, 1), ("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, label int").repartition(5)
    per = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    cum = ranges.cumulated(per, ["k"], "v", ["n", "pos"], 16).collect()
    for r in cum:
        before = [x for x in rows if x[0] == r["k"] and x[1] is not None and x[1] < r["v"]]
        assert (r["n_before"], r["pos_before"]) == (len(before), sum(x[2] for x in before))
        assert r["n_total"] == sum(x[0] == r["k"] and x[1] is not None for x in rows)
    assert len(cum) == per.count()
    got = {r["k"]: r for r in aggregate.quantiles(df, ["k"], "v", 0.35).collect()}
    whole = {r["k"]: r for r in aggregate.population(df, ["k"], "v", "label").collect()}
    for k in ("hot", "cold", None, "one"):
        v = sorted(x[1] for x in rows if x[0] == k and x[1] is not None)
        at = (len(v) - 1) * 0.35
        assert (got[k]["floored"], got[k]["rounded"]) == (v[int(at)], v[round(at)]) and got[k]["interpolated"] == pytest.approx(float(np.quantile(v, 0.35)))
        assert whole[k]["median"] == pytest.approx(float(np.median(v)))
    assert "none" not in got and whole["none"]["median"] is None
    scored = df.where("v is not null").select("k", "label", F.col("v").alias("score"))
    auc, ap = ({r["k"]: r[1] for r in f(scored, ["k"]).collect()} for f in (classify.roc_auc, classify.average_precision))
    for k in ("hot", "cold", None):
        pos, neg = ([x[1] for x in rows if x[0] == k and x[1] is not None and x[2] == y] for y in (1, 0))
        assert auc[k] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
        steps = sorted(set(pos + neg), reverse=True)
        assert ap[k] == pytest.approx(sum(pos.count(s) / len(pos) * sum(p >= s for p in pos) / (sum(p >= s for p in pos) + sum(q >= s for q in neg)) for s in steps))
    assert classify.roc_auc(scored.where("k = 'hot'").drop("k"), []).first()[0] == pytest.approx(auc["hot"])


def test_clusters_pass_on_their_state(spark):
    """Blocks of 7 give the clusters of one pass over each namespace, and a query's own vector is in none."""
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 3 > 0], i, float((i * 37) % 200), [float(x) for x in rng.normal(0, 1, 3)]) for i in range(60)]
    m = spark.createDataFrame(rows, "memory_namespace string, memory_id bigint, released_order double, m_embedding array<double>").repartition(4)
    for rule in (cluster.threshold_rule(0.6), cluster.size_aware_rule(alpha=1.0, beta=1.0, gamma=0.5, tau=0.1, tau_new=0.4)):
        members, heads = cluster.clusters(m, rule, block=7)
        got, ends = {(r["memory_namespace"], r["memory_id"]): r["cluster"] for r in members.collect()}, {(r["memory_namespace"], r["cluster"]): r for r in heads.collect()}
        for ns in "ab":
            own = sorted((o, i, v) for n, i, o, v in rows if n == ns)
            places, held = cluster.formed(np.array([v for *_, v in own]), rule)
            assert [got[ns, i] for _, i, _ in own] == places and max(places) > 0
            for c in range(len(held.sums)):
                assert ends[ns, c]["members"] == places.count(c) and ends[ns, c]["total"] == pytest.approx(held.sums[c].tolist())
        assert len(got) == 60
    assert [x.collect() for x in cluster.clusters(m.limit(0), cluster.threshold_rule(0.5))] == [[], []]


def test_impact_blocks_prune():
    """Memories that can't be among the best aren't scored, and the best are the same."""
    rng = np.random.default_rng(3)
    docs = [[f"t{i // 64}", "all", *(f"r{int(x)}" for x in set(rng.integers(0, 50, 3)))] for i in range(64 * 40)]
    right = pa.table({"terms": docs, "tf": [[1] * len(d) for d in docs], "dl": [len(d) for d in docs]})
    left = pa.table({"terms": [["t3", "all", "r7"]], "idf": [[4.0, 0.01, 2.5]], "avgdl": [4.5]})
    cell, seen = cells.Bm25(left, right), []
    add = cell._add
    cell._add = lambda out, i, runs, idf: (seen.append(len(np.unique(cell.run_block[runs]))), add(out, i, runs, idf))
    found, scores = cell.pruned(0, 10)
    whole = cell.scores(0)
    assert sum(seen[:-1]) < 40 and seen[-1] == 40
    best = sorted(zip(-scores, found, strict=True))[:10]
    assert [i for _, i in best] == sorted(range(len(docs)), key=lambda i: (-whole[i], i))[:10] and all(whole[i] == -s for s, i in best)


def test_blocks_spread_a_single_key(spark):
    rng = np.random.default_rng(1)
    m = spark.createDataFrame([("", i, 1, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(240)], "key string, memory_id bigint, fact bigint, m_embedding array<double>")
    q = m.where("memory_id < 60").select("key", F.col("memory_id").alias("query_id"), F.lit(0).alias("fact"), F.col("m_embedding").alias("q_embedding"))
    found = rank.blocked_dense(q, m, 5, block=10, chunk=8, slice_rows=30)
    pairs = q.select("query_id", "q_embedding").join(m.select("memory_id", "m_embedding"), F.col("query_id") != F.col("memory_id"))
    assert _best(rank.top_k(found, 5)) == _best(rank.top_k(rank.dense(pairs), 5))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_statistics(spark):
    deltas = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6, 7)], "delta double")
    assert tuple(stats.sign_flip(deltas, "delta").first()) == (7, 0.015625)
    assert stats.sign_flip(deltas.where("delta < 0"), "delta").first()["p"] == 1.0
    rows = spark.createDataFrame([("large", 1.0)] * 4 + [("small", -1.0)], "c string, v double")
    assert stats.cluster_macro_bootstrap(rows, "c", "v", 20, "1").first()["estimate"] == 0
    exposure = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "e boolean, u boolean")
    assert stats.risk_difference(exposure, "e", "u").first()[0] == 0.5
    assert [r["loo"] for r in aggregate.leave_one_out(deltas, "delta").orderBy("delta").collect()][0] == pytest.approx(4.5)


def test_bootstraps_without_sql_draw_the_whole_number(spark, monkeypatch):
    queries, sf = __spark_entry__.queries(), "/root/testdata/sf0.001"
    for k in ("cluster_macro_bootstrap", "paired_bootstrap", "case_weighted_delta", "scenario_bootstrap"):
        few, full = queries[k](spark, sf).first(), queries[f"{k}_full"](spark, sf).first()
        assert full["replicates"] == 10_000 and full["estimate"] == few["estimate"]
    drawn = []
    monkeypatch.setattr(stats, "binary_agreement_bootstrap", lambda *a: drawn.append(a[4]))
    monkeypatch.setattr(stats, "scenario_bootstrap", lambda *a: drawn.append(a[4]))
    queries["agreement_bootstrap"](spark, sf), queries["exposure_cell_bootstrap"](spark, sf)
    assert drawn == [10_000, 10_000]


def test_agreement(spark):
    pairs = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean")
    r = classify.binary_agreement(pairs, "a", "b").first()
    assert (r["exact"], r["kappa"]) == (0.75, 0.5) and r["ac1"] == pytest.approx(0.5294117647058824)
    q = classify.quality_agreement(spark.createDataFrame([(0, 0), (5, 6), (10, 8)], "a int, b int"), "a", "b").first()
    assert q["exact"] == pytest.approx(1 / 3) and q["within_one"] == pytest.approx(2 / 3) and q["mae"] == 1


def test_discrimination_as_brute_force(spark):
    rnd = random.Random(2)
    data = [(rnd.random() < 0.4, rnd.choice([0.1, 0.2, 0.35, 0.5, 0.9, 1.0])) for _ in range(200)]
    rows = spark.createDataFrame([(int(y), s) for y, s in data], "label int, score double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert classify.roc_auc(rows, []).first()[0] == pytest.approx(auc)
    ece = 0
    for i in range(10):
        own = [(y, s) for y, s in data if i / 10 <= s <= (i + 1) / 10 and (i == 9 or s < (i + 1) / 10)]
        ece += abs(sum(y for y, _ in own) - sum(s for _, s in own)) / len(data)
    assert classify.calibration_error(rows, []).first()[0] == pytest.approx(ece)
    assert classify.roc_auc(rows.where("label = 1"), []).first()[0] is None


def test_incomplete_bundle_and_collisions_raise(spark):
    units = spark.createDataFrame([("u", "c", ["the"])], "unit_id string, cell string, markers array<string>")
    half = spark.createDataFrame([("u", "exposed", "in The end", "answer")], "unit_id string, exposure string, answer string, action string")
    with pytest.raises(Exception, match="incomplete"):
        paired.exposure_scores(units, half).collect()
    whole = half.unionByName(spark.createDataFrame([("u", "withheld", "other", "refuse")], half.schema))
    r = paired.exposure_scores(units, whole).first()
    assert (r["exposed_disclosure"], r["withheld_disclosure"], r["exposure_effect"], r["refusal_effect"]) == (1, 0, 1, -1)
    with pytest.raises(Exception, match="collision"):
        paired.requests(spark.createDataFrame([("h", "a"), ("h", "b")], "prompt_sha256 string, payload string")).collect()


def test_every_turn_is_scored(spark, tmp_path):
    said = [(0, "user", "tell me all"), (1, "assistant", "in the end it was all said"), (2, "user", "zz top"), (3, "assistant", "zz top"), (4, "user", "unanswered")]
    rows = [(6, *x) for x in said] + [(7, 0, "system", "be brief"), (7, 1, "user", "a b"), (7, 2, "assistant", "b c"), (8, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    queries = __spark_entry__.queries()
    got = {k: queries[k](spark, str(tmp_path)).collect() for k in ("exposure_scores", "cell_metrics_turns", "query_similarity", "token_jaccard_turns", "answer_metrics")}
    assert {r["unit_id"]: (r["exposed_disclosure"], r["withheld_disclosure"]) for r in got["exposure_scores"]} == {"6|0": (1, 0), "6|2": (0, 0), "7|1": (0, 0)}
    assert {(r["cell"], r["unit_count"]) for r in got["cell_metrics_turns"] if r["axis"] == "all"} == {("relevant_admissible", 2), ("irrelevant_inadmissible", 1)}
    assert {(r["conv_id"], r["turn"]): r["jaccard"] for r in got["token_jaccard_turns"]} == {(6, 0): 0.111111, (6, 2): 1.0, (7, 1): 0.333333}
    assert {(r["conv_id"], r["turn"]): r["query_sequence_similarity"] for r in got["query_similarity"]}[6, 2] == 1
    assert {(r["conv_id"], r["turn"]): r["exact_match"] for r in got["answer_metrics"]} == {(6, 0): False, (6, 2): True, (7, 1): False}


def test_inferred_gates_payloads_and_calibration(spark):
    rows = [("a", 1, True, 0.9, 0.1), ("a", 2, None, 0.9, 0.8), ("a", 3, False, 0.2, 0.1)]
    frozen = spark.createDataFrame(rows, "case_id string, rank int, admissible boolean, p_violation double, p_unknown double").withColumns({"v": F.lit(0.5), "u": F.lit(0.5)})
    kept = {}
    for r in arms.inferred_gates(frozen).collect():
        kept.setdefault(r["setting_id"], set()).add(r["rank"])
    assert kept == {"namespace_dense": {1, 2, 3}, "released_oracle": {1, 2}, "text_inferred": {3}, "abstaining_verifier": {2, 3}}
    units = spark.createDataFrame([("u", "Q", "b", [("a", "x"), ("b", "y")])], "unit_id string, query string, candidate_key string, candidates array<struct<candidate_key string, text string>>")
    seen = {r["exposure"]: r["payload"] for r in paired.request_payloads(units).collect()}
    assert seen == {"exposed": '{"candidates":[{"candidate_key":"a","text":"x"},{"candidate_key":"b","text":"y"}],"query":"Q"}', "withheld": '{"candidates":[{"candidate_key":"a","text":"x"}],"query":"Q"}'}
    cases = spark.createDataFrame([(1, 2, 70), (1, 5, 80)], "case_id int, rank int, memory_id int")
    said = spark.createDataFrame([(1, 1, 0.1, 0.2), (1, 2, 0.3, 0.4)], "case_id int, position int, p_violation double, p_unknown double")
    assert {r["memory_id"]: r["p_violation"] for r in paired.verifier_scores(cases, said).collect()} == {70: 0.1, 80: 0.3}
    with pytest.raises(Exception, match="differ"):
        paired.verifier_scores(cases, said.where("position = 1")).collect()
    # Case 1 calibrates: 0.6 is the threshold that drops its violation and keeps what it needs. Case 2 would choose otherwise.
    data = [(1, 10, 1, True, True, True, True, True, 0.5, 0.0), (1, 11, 2, False, True, False, True, False, 0.7, 0.0), (2, 20, 1, False, True, False, True, False, 0.55, 0.0), (2, 21, 2, True, True, True, True, True, 0.1, 0.0)]
    candidates = spark.createDataFrame(data, "query_id int, memory_id int, rank int, relevant boolean, scope_ok boolean, policy_ok boolean, lifecycle_ok boolean, anchor boolean, p_violation double, p_unknown double").withColumn("admissible", F.col("policy_ok"))
    grid = spark.createDataFrame([(0.5, None), (0.6, None), (0.9, None)], "v double, u double")
    owners = spark.createDataFrame([(1, "s", 1), (2, "s", 1)], "query_id int, source string, anchor_total int")
    got = {r["setting_id"]: r for r in retrieval.calibrated(candidates, owners, F.col("query_id") == 1, grid, 0.0, 1.0).collect()}
    assert {k: (r["query_id"], r["v"], r["route_width"]) for k, r in got.items()} == {"namespace_dense": (2, 0.6, 2), "released_oracle": (2, 0.6, 1), "text_inferred": (2, 0.6, 2), "abstaining_verifier": (2, 0.6, 2)}


def test_text_and_hash_functions(spark):
    r = spark.createDataFrame([("Straße ÉTÉ_1, x", "ﬁne №5 Ünder")], "a string, b string").select(scalar.normalize_answer(F.col("a")), scalar.normalize_disclosure(F.col("b")), scalar.truncate_utf8(F.col("a"), 5), scalar.uniform("1", F.lit("x")), scalar.canonical_json(b=F.lit(None).cast("int"), a=F.lit(1))).first()
    assert r[0] == "strasse été_1 x" and r[1] == "fine no5 nder" and r[2] == "Stra" and r[4] == '{"a":1,"b":null}'
    import hashlib

    assert r[3] == int.from_bytes(hashlib.sha256(b"1\0x").digest()[:8], "big") / 2**64


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "b"), (1, 0.5, "a")], "n int, v double, k string")
    io.write_jsonl(df, str(tmp_path / "j"), gzip=True)
    assert sorted(io.read_jsonl(spark, str(tmp_path / "j"), "k string, n int, v double").collect(), key=lambda r: r["k"])[0]["v"] == 0.5
    io.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "n int, v double, k string").where("v IS NULL").count() == 1
    assert io.manifest(spark, str(tmp_path / "c"), 2).first()["row_count"] == 2
    with pytest.raises(ValueError):
        io.write_csv(df.limit(0), str(tmp_path / "e"))
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{nope\n')
    with pytest.raises(Exception, match="[Mm]alformed|FAILFAST"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int").collect()
    assert io.unsorted_ids(df, "k", "n").count() == 0 and quality.one(df, k="a").first()["n"] == 1
    with pytest.raises(ValueError, match="dup"):
        quality.require(quality.expectations({"dup": quality.duplicates(df.union(df), ["k"])}))


def test_streamed_windows_match_batch(spark, tmp_path):
    from quillon.streaming import events

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    events.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got, want = ({(r["hour"], r["event_type"]): r["n"] for r in d.collect()} for d in (spark.read.parquet(str(tmp_path / "out")), events.hourly(rows)))
    # The watermark closes every window but the latest: those are all there, and none differs.
    assert got == {k: n for k, n in want.items() if k in got} and len(got) >= len(want) - len({e for _, e in want}) * 2 > 0


def test_entry_and_plans(spark):
    assert __spark_entry__.entry(spark).count() == len(arms.DENSE)
    assert "WindowGroupLimit" in arms.dense_arm(spark.createDataFrame(ROWS, PAIRS), "global_dense")._jdf.queryExecution().executedPlan().toString()


def test_streams_are_dealt_by_place(spark):
    import hashlib

    import numpy as np

    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i) for i in rnd.sample(range(400_000), 500)]
    got = {(r["k"], r["i"]): r["u"] for r in corrupt.vector_stream(spark.createDataFrame(rows, "k string, i bigint").repartition(5), ["k"], "i", 7, "c").collect()}
    for k in "ab":
        stream = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"7\0c\0{k}".encode()).digest()[:8], "big")))
        own = sorted(i for x, i in rows if x == k)
        assert [got[k, i] for i in own] == stream.random(len(own)).tolist()
    numbers = support.numbered(spark.createDataFrame(rows, "k string, i bigint"), ["k"], F.floor(F.col("i") / 1000), ["i"], "n").collect()
    assert all(r["n"] == 1 + sum(x == r["k"] and i < r["i"] for x, i in rows) for r in numbers)


def test_agreement_bounds(spark):
    pairs = spark.createDataFrame([(i, i % 10 < 7, i % 10 < 6 or i % 50 == 9) for i in range(400)], "id bigint, a boolean, b boolean")
    r = stats.binary_agreement_bootstrap(pairs, "a", "b", "id", 2000, "s").first()
    one = classify.binary_agreement(pairs, "a", "b").first()
    for m in ("exact", "kappa", "ac1"):
        assert r[f"{m}_lower"] < one[m] < r[f"{m}_upper"]
    assert r["exact_upper"] - r["exact_lower"] == pytest.approx(2 * 1.96 * (one["exact"] * (1 - one["exact"]) / 400) ** 0.5, rel=0.1)


def test_pooled_arms_are_the_arms_over_pairs(spark):
    rnd = random.Random(8)

    def vector():
        return [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]

    memories = [(i, rnd.choice("ab"), rnd.choice(status.LIFECYCLE), rnd.choice([True, False, None]), rnd.choice([True, False, None]), float(i), vector()) for i in range(60)]
    queries = [(i, "s", "g", rnd.choice("abc"), rnd.choice(status.INTENT), rnd.choice(["content_disclosure", "operation_trace", "other"]), vector()) for i in (0, 3, 7, 11, 90)]
    m = spark.createDataFrame(memories, "memory_id bigint, memory_namespace string, lifecycle_state string, content_allowed boolean, trace_allowed boolean, released_order double, m_embedding array<double>")
    q = spark.createDataFrame(queries, "query_id bigint, source string, group_id string, namespace string, intent string, purpose string, q_embedding array<double>")
    pairs, names = q.join(m, F.col("query_id") != F.col("memory_id")), list(arms.DENSE)
    keys = ["setting_id", "query_id", "memory_id", "rank", "score"]
    assert sorted(map(tuple, arms.pooled_arms(q, m, names, 5).select(keys).collect())) == sorted(map(tuple, arms.dense_arms(pairs, names, 5).select(keys).collect()))
    keys = ["setting_id", "source", "group_id", "query_id", "candidates_scored", "route_width"]
    assert sorted(map(tuple, arms.pooled_stats(q, m, names).select(keys).collect())) == sorted(map(tuple, arms.route_stats(pairs, names).select(keys).collect()))


def test_a_ranked_memory_without_an_assessment_raises(spark):
    labels, ranked = spark.createDataFrame(LABELS, LABEL_SCHEMA), spark.createDataFrame([("s", 1, 99, 1)], "setting_id string, query_id bigint, memory_id bigint, rank int")
    runs = spark.createDataFrame([("s", "x", "g", 1, 3, 1)], "setting_id string, source string, group_id string, query_id bigint, candidates_scored bigint, route_width int")
    with pytest.raises(Exception, match="no assessment"):
        prefix.score_route(ranked, labels, runs, 1.0).collect()
    with pytest.raises(ValueError, match="zero vector"):
        import numpy as np

        cluster.formed(np.zeros((2, 3)), cluster.threshold_rule(0.5))


def test_records_are_checked(spark):
    rows = spark.createDataFrame([(1, -1.0), (2, 1.0)], "id bigint, cost double")
    with pytest.raises(Exception, match="not negative"):
        rows.select(prefix.passed_on(F.col("cost"))).collect()
    with pytest.raises(Exception, match="duplicate"):
        io.unique_ids(rows.unionByName(rows), "id").collect()
    with pytest.raises(ValueError, match="empty"):
        io.not_empty(rows.limit(0))
    cases = spark.createDataFrame([("c", "arm", "p")], "case_id string, arm string, prompt_sha256 string")
    answers = spark.createDataFrame([("q", "x", "answer")], "prompt_sha256 string, answer string, action string")
    with pytest.raises(Exception, match="missing"):
        paired.judged_scores(cases, answers, spark.createDataFrame([], "case_id string, answer_sha256 string, correct boolean, quality double")).collect()
    assert [r["place"] for r in quality.in_same_order(rows.withColumn("place", F.col("id")), rows.where("id = 1").withColumn("place", F.col("id")), "id", "place").collect()] == [2]
