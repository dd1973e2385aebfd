"""What grows with the input: cells, copies and what leaves a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import rank


def _sides(spark, n: int, asked: int):
    rng = np.random.default_rng(5)
    m = spark.createDataFrame([("", i, 1, [float(x) for x in rng.normal(size=4)]) for i in range(n)], "key string, memory_id bigint, fact bigint, m_embedding array<double>")
    q = m.where(f"memory_id < {asked}").select("key", F.col("memory_id").alias("query_id"), F.lit(0).alias("fact"), F.col("m_embedding").alias("q_embedding"))
    return q, m


def _rows(df):
    return sorted((r["query_id"], r["memory_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


def test_small_blocks_do_not_make_a_cell_a_pair(spark):
    q, m = _sides(spark, 240, 60)
    found = rank.blocked_dense(q, m, 2, block=1, chunk=3, slice_rows=1)
    assert found.count() <= 60 * rank.CELLS * 2
    pairs = q.select("query_id", "q_embedding").join(m.select("memory_id", "m_embedding"), F.col("query_id") != F.col("memory_id"))
    assert _rows(rank.top_k(found, 2)) == _rows(rank.top_k(rank.dense(pairs), 2))


def test_equal_vectors_tie_wherever_they_stand(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=64)] for _ in range(3)]
    m = spark.createDataFrame([("", i, 1, vectors[i % 3]) for i in range(100)], "key string, memory_id bigint, fact bigint, m_embedding array<double>")
    q = m.where("memory_id < 7").select("key", F.col("memory_id").alias("query_id"), F.lit(0).alias("fact"), F.col("m_embedding").alias("q_embedding"))
    got = rank.top_k(rank.blocked_dense(q, m, 10, block=2, chunk=5, slice_rows=9), 10).collect()
    for i in range(7):
        assert [r["memory_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [j for j in range(i % 3, 100, 3) if j != i][:10]


def test_an_arm_by_the_class_that_it_holds_a_memory_for(spark):
    q, m = _sides(spark, 90, 12)
    classes = q.withColumn("fact", (F.col("query_id") % 3).cast("bigint"))
    dealt = m.withColumn("fact", F.array((F.col("memory_id") % 3), (F.floor(F.col("memory_id") / 7) % 3)))
    found = rank.blocked_dense(classes, dealt, 4, arms=2, block=5, chunk=6, slice_rows=20)
    pairs = classes.drop("key").join(dealt.select("memory_id", "m_embedding", F.col("fact").alias("of")), F.col("query_id") != F.col("memory_id"))
    for arm in range(2):
        own = rank.top_k(found.where(F.col("held").bitwiseAND(1 << arm) != 0), 4)
        assert _rows(own) == _rows(rank.top_k(rank.dense(pairs.where(F.col("of")[arm] == F.col("fact"))), 4))


def test_vectors_are_not_repeated_by_seed(spark, monkeypatch):
    from quillon.plans import controls
    from quillon.sources import model

    seen, whole = [], rank.blocked_dense
    monkeypatch.setattr(rank, "blocked_dense", lambda q, m, *a, **b: (seen.append((m.count(), q.count())), whole(q, m, *a, **b))[1])
    path = "/root/testdata/sf0.001"
    controls._routes(spark, path)
    assert max(seen) <= (model.candidates(spark, path).count(), model.queries(spark, path).count())


def test_routers_need_no_row_a_pair(spark):
    from quillon.operators import arms, cluster

    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 3 == 0], float(i), [float(x) for x in rng.normal(size=3)]) for i in range(200)]
    m = spark.createDataFrame(rows, "memory_id bigint, memory_namespace string, released_order double, m_embedding array<double>")
    q = m.where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), F.col("memory_namespace").alias("namespace"), F.col("m_embedding").alias("q_embedding"))
    rest = m.where("memory_id % 20 <> 0")
    pairs = q.join(rest, F.col("namespace") == F.col("memory_namespace"))
    keys = ["query_id", "memory_id", "rank", F.round("score", 9), "cluster", "fallback_used", "route_width"]
    for theta, top_l in ((0.95, 3), (0.999, 2), (0.2, 1)):
        one, other = (f.select(*keys) for f in (arms.pooled_threshold_router(q, rest, theta=theta, top_l=top_l, top_k=9), arms.threshold_router(pairs, rest, theta=theta, top_l=top_l, top_k=9)))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    one, other = (f.select(*keys) for f in (arms.pooled_cluster_router(q, rest, top_l=2, top_k=9), arms.cluster_router(pairs, rest, top_l=2, top_k=9)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_cells_stay_few_as_both_sides_grow():
    from quillon.operators import cells

    for least, most in ((256, 4096), (1 << 14, 1 << 16)):
        assert [cells._parts(n, least, most) for n in (0, 1, least, 2 * least)] == [1, 1, 1, 2]
        assert cells._parts(rank.CELLS * most, least, most) == rank.CELLS  # before: n / least
        assert cells._parts(100 * most, least, most) == 100


def test_masks_are_counted_by_kind_and_level():
    """Before, every pair of a cell went through the masks of every channel."""
    from quillon.operators import corrupt_grid as g
    from quillon.operators.corrupt import CHANNELS

    grid, rng, n = g.Grid(["namespace_dense", "released_governance_oracle_v2"], list(CHANNELS), [0.0, 0.2, 0.6], [1, 4], ["a", "b"]), np.random.default_rng(3), 400
    flags = {f: rng.random(n) < 0.5 for f in g.FLAGS}
    drawn = rng.integers(0, 4, (n, len(grid.pairs), 2)).astype(np.uint8)
    m = g.Rows(**flags, levels=np.zeros((n, len(grid.records), 2), np.uint8), alternates=np.zeros((n, 2), np.uint8), pair_levels=drawn)
    for q in (g.Query(grid, "s", 20, "a", "current_state"), g.Query(grid, "s", 40, "b", "history")):
        for channel in (*grid.pairs, "query_intent_flip"):
            rows = np.flatnonzero(rng.random(n) < 0.9)
            assert (g._counted(grid, q, m, rows, channel) == g._counts(grid, q, m.take(rows), channel)).all()
    assert len(set(g.draws(3, "c", "f", [b"x", b"y"] * 700).tolist())) == 2


def test_rankings_of_cells_grow_in_tasks(spark, monkeypatch):
    """Before, Spark joined the cells' rows to tasks by packed bytes, and the ranking moved them by arm and query."""
    monkeypatch.setattr(rank, "FEW", 40)
    q, m = _sides(spark, 240, 60)
    found = rank.blocked_dense(q, m, 2, slice_rows=30)  # 8 slices pass on 2 memories a query each
    ranked = rank.top_k(found, 2)
    assert found.rdd.getNumPartitions() == ranked.rdd.getNumPartitions() == 60 * 8 * 2 // 40
    pairs = q.select("query_id", "q_embedding").join(m.select("memory_id", "m_embedding"), F.col("query_id") != F.col("memory_id"))
    assert _rows(ranked) == _rows(rank.top_k(rank.dense(pairs), 2))


def test_copies_for_cells_grow_in_tasks(spark, monkeypatch):
    """Before, a task of the scan made all copies of its rows, and held them until its shuffle was written."""
    monkeypatch.setattr(rank, "COPIES", 100)
    q, m = _sides(spark, 240, 60)
    assert rank._spread(m, "memory_id", 100) is m
    assert rank._spread(m, "memory_id", 240 * 4 + 1).rdd.getNumPartitions() == 10
    dealt = rank.top_k(rank.blocked_dense(q, m, 2, block=15, slice_rows=30), 2)
    pairs = q.select("query_id", "q_embedding").join(m.select("memory_id", "m_embedding"), F.col("query_id") != F.col("memory_id"))
    assert _rows(dealt) == _rows(rank.top_k(rank.dense(pairs), 2))


def test_scored_rows_have_labels_beside_and_tasks_by_number(spark, monkeypatch):
    """Before, labels were made for the distinct pairs and joined a second time, and tasks followed packed bytes."""
    import pytest

    from quillon.operators import arms, prefix
    from quillon.plans import retrieval
    from quillon.sources import model

    path, names = "/root/testdata/sf0.001", ["global_dense", "namespace_dense"]
    ranked = retrieval._frozen(spark, path, names, 20)
    beside = model.assessed(spark, path, ranked)
    joined = prefix.assessed(ranked, model.assessments(spark, path, ranked)).select(beside.columns)
    assert sorted(map(str, beside.collect())) == sorted(map(str, joined.collect()))
    monkeypatch.setattr(prefix, "ROWS", ranked.count() // 4)
    parts, runs = prefix.tasks(ranked), arms.pooled_stats(model.queries(spark, path), model.candidates(spark, path), names)
    assert parts in (4, 5) and prefix._dealt(beside, parts).rdd.getNumPartitions() == parts
    one, other = (prefix.score_route(*x, runs, 0.2, model.anchors(spark, path), n) for x, n in (((beside, None), parts), ((ranked, model.assessments(spark, path, ranked)), None)))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect()))
    unknown = spark.createDataFrame([("a", 0, -1, 1)], "setting_id string, query_id bigint, memory_id bigint, rank int")
    with pytest.raises(Exception, match="no assessment"):
        model.assessed(spark, path, unknown).collect()


def test_letting_in_is_hashed_without_python_in_dealt_cells(spark, monkeypatch):
    """Before, a Python loop hashed the pairs of a cell, whose number followed the queries alone."""
    from quillon.operators import corrupt_grid as g

    rates, seeds, n = [0.0, 0.02, 0.5], [0, 7], 300
    m = spark.range(n).select(F.col("id").alias("memory_id"), F.when(F.col("id") % 7 < 4, "en").otherwise("fr").alias("memory_namespace"))
    q = m.where("memory_id % 20 = 0").select(F.lit("s1").alias("source"), F.col("memory_id").alias("query_id"), F.col("memory_namespace").alias("namespace"))
    spaces, ids = ["en" if i % 7 < 4 else "fr" for i in range(n)], [r["query_id"] for r in q.collect()]

    def found(memories):
        return g.let_in(q, memories, rates, seeds, [F.col("source"), F.col("query_id").cast("string")], ["gate"], "c")

    def expected(i, s, r):
        names = [f"{j}\0gate".encode() for j in range(n) if spaces[j] != spaces[i]]
        return int((g.draws(s, "c", f"s1\0{i}", names) < r).sum())

    assert [g._side(*x, 1 << 16) for x in ((1, 20), (513, 10_256), (30_769, 615_384), (307_690, 6_153_840))] == [1, 4, 32, 94]
    wanted = {(str(s), r, i): expected(i, s, r) for s in seeds for r in rates for i in ids}
    for pairs in (1 << 18, 100):  # one cell, 36 cells
        monkeypatch.setattr(g, "PAIRS", pairs)
        got = found(m)
        assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "InArrow" not in plan
        assert {(r["seed"], r["rate"], r["query_id"]): r["outside"] for r in got.collect()} == wanted
    alone = found(m.where("memory_namespace = 'en'")).where("outside = 0").select("query_id").distinct().collect()
    assert {r["query_id"] for r in alone} >= {i for i in ids if spaces[i] == "en"}  # none is left out


def test_bounds_of_draws_are_those_of_doubles():
    from quillon.operators import corrupt_grid as g

    for rate in (0.02, 0.05, 0.1, 0.3, 0.5, 1 / 3, 1e-19):
        first = int(g._below(rate), 16)
        assert not first / 2.0**64 < rate and (first - 1) / 2.0**64 < rate
    assert g._below(0.0) == "0" * 16 and g._below(1.5) == "g"


def test_swaps_are_drawn_once_for_all_rates(spark):
    """Before, every rate drew its swaps again."""
    from quillon.operators import corrupt, corrupt_grid as g

    rates, seeds = [0.0, 0.1, 0.5], [0, 3]
    m = spark.range(60).select(F.lit("s0").alias("source"), F.col("id").alias("memory_id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("memory_namespace"))
    words = m.agg(F.array_sort(F.collect_set("memory_namespace")).alias("vocabulary"))
    found = g.swapped(m, words, rates, seeds)
    assert found.count() == 60 * len(seeds)
    got = {(rate, r["seed"], r["memory_id"], r["other"] if r["level"] <= i else r["memory_namespace"]) for r in found.collect() for i, rate in enumerate(rates)}
    fields = {"lifecycle_state": "string", "content_allowed": "boolean", "trace_allowed": "boolean", "query_id": "bigint", "namespace": "string", "intent": "string"}
    pairs = m.withColumns({c: F.lit(None).cast(t) for c, t in fields.items()})
    whole = corrupt.corrupt(pairs, corrupt.grid(spark, ["namespace_swap"], rates, seeds), words)
    assert got == {(r["rate"], r["seed"], r["memory_id"], r["memory_namespace"]) for r in whole.collect()}


def test_no_name_of_a_module_is_defined_twice():
    """Before, let_in's _side took the place of the cells' _side, and every corruption query failed."""
    import ast
    from pathlib import Path

    import quillon

    for path in Path(quillon.__file__).parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not n.decorator_list]
        assert len(names) == len(set(names)), path


def test_products_score_only_what_they_leave_open():
    """Before, a query's scores were summed by postings, with each impact at its own mean length, for every memory of every cell."""
    import pyarrow as pa

    from quillon.operators import cells

    rng, n = np.random.default_rng(6), 400
    docs = [[f"w{x}" for x in np.unique(np.minimum(rng.zipf(1.3, int(rng.integers(0, 40))), 900))] for _ in range(n)]
    docs[30:60], docs[61], docs[62] = [docs[3]] * 30, [], ["alone"]
    tf = [rng.integers(1, 6, len(d)).tolist() for d in docs]
    tf[30:60] = [tf[3]] * 30
    right = pa.table({"terms": docs, "tf": pa.array(tf, pa.list_(pa.int32())), "dl": [sum(x) for x in tf]})
    asked = [*docs[:99], ["w1", "unheard"], ["unheard"]]
    left = pa.table({"terms": pa.array(asked, pa.list_(pa.string())), "idf": pa.array([rng.random(len(d)).tolist() for d in asked], pa.list_(pa.float64())), "avgdl": rng.uniform(30, 33, len(asked))})
    ids, whole, products, seen = np.arange(n), cells.Bm25(left, right), cells.Products(left, right), []
    assert 0 < len(products.impacts) < 100 and len(products.doc)
    some = products.some
    products.some = lambda i, at: (seen.append(len(at)), some(i, at))[1]
    for i in range(len(asked)):
        scores, others = whole.scores(i), ids != i
        at, found = products.pruned(i, 20)
        assert np.allclose(scores[at], found, rtol=0, atol=1.1e-9)
        best = [j for j in sorted(range(n), key=lambda j: (-scores[j], j))[:20] if scores[j] > 0]
        assert [j for _, j in sorted(zip(-found, at, strict=True))][:20] == best
        stated = rng.choice(n, 30, replace=False)
        known = some(i, stated)
        want = cells._Cell.better(whole, i, known, stated, ids, others)
        assert (products.better(i, known, stated, ids, others) == want).all()
        assert (want == [sum(others[j] and (scores[j] > v + 1e-9 or (abs(scores[j] - v) <= 1e-9 and j < t)) for j in range(n)) for v, t in zip(known, stated, strict=True)]).all()
    assert sum(seen) < len(seen) * n / 2


def test_lexical_ranking_by_products(spark, monkeypatch):
    from quillon.operators import cells
    from tests.test_operators import _best, _corpus

    queries, memories, pairs = _corpus(spark)
    lexical = rank.bm25(queries.select("query_id", "text"), memories.select("memory_id", "text"), pairs.select("query_id", "memory_id")).withColumn("score", F.round("score", 9)).cache()
    monkeypatch.setattr(cells, "ASKED", 0)
    words = cells.bm25_corpus(queries, memories.withColumn("text", F.when(F.col("text") != "", F.col("text"))), group=13, slice_rows=50)
    assert _best(cells.ranked(words, memories, 30)) == _best(rank.top_k(lexical, 30))
    assert _best(cells.fused(words, cells.dense_corpus(queries, memories), memories, 7)) == _best(rank.top_k(rank.rrf(lexical, rank.dense(pairs)), 7))


def test_memories_move_once_for_many_queries(spark):
    """Before, 30,769 queries met an index of 615,384 texts in 8 groups, and vectors in 16."""
    from quillon.operators import cells

    for kind in (cells.Bm25, cells.Dense):
        corpus = cells.Corpus.__new__(cells.Corpus)
        cells.Corpus.__init__(corpus, *(spark.createDataFrame([], f"{x}_id bigint, " + ", ".join(f"{c} int" for c in of)) for x, of in (("query", kind.left), ("memory", kind.right))), None, kind)
        groups, slices = (cells._parts(x, *size) for x, size in zip((30_769, 615_384), corpus.sizes, strict=True))
        assert groups == 2 and slices >= 16


def test_texts_are_dealt_by_number(spark, monkeypatch):
    """Before, the texts that have vectors stayed in those few tasks of the scan that had read them."""
    from quillon.operators import cells

    monkeypatch.setattr(cells, "TEXTS", 10)
    counted = cells._counted
    monkeypatch.setattr(cells, "_counted", lambda batches: counted(batches))
    kept, written = [], cells.io.written
    monkeypatch.setattr(cells.io, "written", lambda df, path: (kept.append(df.rdd.getNumPartitions()), written(df, path))[1])
    texts = spark.range(95).coalesce(1).select(F.col("id").alias("memory_id"), F.lit("a b a").alias("text"))
    cells.bm25_corpus(texts.where("memory_id < 5").select(F.col("memory_id").alias("query_id")), texts)
    assert kept[0] == 10
