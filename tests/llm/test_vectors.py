"""Brute-force checks of the vector operators (codes, whitening, nearest neighbours) with the edge cases that their docstrings define."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import nearest, vector_codes, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, n int, x string, place string, grp int, component int"
NAN, INF = float("nan"), float("inf")


def rows(n=300, dims=32, seed=3):
    """(vec_id, embedding, label): a third of the rows hold one vector; with nulls, ties, repeated rows and odd vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (n, dims)).astype(np.float32)
    base[rng.random(n) < 0.33] = base[1]
    base[50:60] = base[40:50] + np.float32(1e-6)
    out = [(i * 5, [float(c) for c in v], int(i % 4) if i % 7 else None) for i, v in enumerate(base)]
    out += [out[3], out[3], (15, [0.0] * dims, 1), (None, out[9][1], 2), (1000, [-c for c in out[9][1]], 2), (-100, out[9][1], None)]
    odd = [(7, None, 1), (8, [], 1), (9, [None] + [0.5] * (dims - 1), 1), (11, [NAN] + [0.5] * (dims - 1), 1), (12, [0.5] * (dims - 1) + [-INF], 1)]
    return out + odd


def frame(spark, data, parts=3):
    return spark.createDataFrame([(i, v, label, "c", 1, "x", "p", 3, 4) for i, v, label in data], SCHEMA).repartition(parts)


def kept(data):
    return [(i, v, label) for i, v, label in data if v and all(c is not None and math.isfinite(c) for c in v)]


def coded(data, parts, entries, rounds, scale):
    """Lloyd's rounds from scratch, in whole numbers."""
    ints = [(i, [math.floor(Fraction(c) * scale) for c in v], label) for i, v, label in kept(data)]
    width = len(ints[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in ints]
    order = sorted(range(len(ints)), key=lambda k: (ints[k][0] is None, ints[k][0] or 0, ints[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in cut:
                members[near(x[p], books[p])[1]].append(x[p])
            books[p] = [tuple(sum(c) // len(members[e]) for c in zip(*members[e], strict=True)) if e in members else old for e, old in enumerate(books[p])]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    errors, by = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(ints, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in f), error, by[label], digest) for (i, _, label), f, error in zip(ints, found, errors, strict=True))


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale", "n"), [(16, 64, 2, 256, 300), (4, 256, 3, 7, 300), (16, 64, 2, 256, 20), (2, 5, 0, 256, 30)])
def test_codes(spark, parts, entries, rounds, scale, n):
    data = rows(n)
    got = vector_codes.encode(frame(spark, data), parts=parts, entries=entries, rounds=rounds, scale=scale)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == coded(data, parts, entries, rounds, scale)


def test_codes_of_large_components_and_bad_tables(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(0, 2e5, (40, 4)).astype(np.float32))]  # products beyond 2^53
    assert Counter(map(tuple, vector_codes.encode(frame(spark, data), parts=2, entries=8).collect())) == coded(data, 2, 8, 2, 256)
    none = vector_codes.encode(frame(spark, [(7, None, 1)]))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="differ"):
        vector_codes.encode(frame(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)]))
    with pytest.raises(ValueError, match="cut"):
        vector_codes.encode(frame(spark, [(1, [0.5] * 17, 1)]))


def test_codes_shuffle_only_what_changed(spark):
    """The second round's delta counts are those of parts that moved, and the running sums equal a fresh sum."""
    data = rows(200)
    ints = np.array([[math.floor(Fraction(c) * 256) for c in v] for _, v, _ in kept(data)])
    books = np.stack([ints[:8, p * 8 : (p + 1) * 8] for p in range(4)])
    schema = vector_codes.STATE.format(label="int")
    start = spark.createDataFrame([(k, 0, v, None) for k, v in enumerate(ints.tolist())], "vec_id bigint, label int, ints array<bigint>, code binary").repartition(3)
    one = spark.createDataFrame(start.mapInArrow(vector_codes._round(books, True), schema).collect(), schema)
    sums = vector_codes._running(None, one)
    moved = vector_codes._moved(books, sums)
    two = spark.createDataFrame(one.where("part is null").select("vec_id", "label", "ints", "code").mapInArrow(vector_codes._round(moved, True), schema).collect(), schema)
    before, after = ({r.vec_id: bytes(r.code) for r in t.where("part is null").collect()} for t in (one, two))
    changed = sum(a != b for k in before for a, b in zip(before[k], after[k], strict=True))
    assert 0 < changed < len(ints) * 4
    deltas = two.where("part is not null").collect()
    assert sum(abs(r.n) for r in deltas) <= 2 * changed and sum(r.n for r in deltas) == 0
    got = {(r.part, r.entry, r.place): (r.n, r.total) for r in vector_codes._running(sums, two).where("n > 0").collect()}
    fresh = defaultdict(lambda: [0, 0])
    for k, code in after.items():
        for p, e in enumerate(code):
            for place in range(8):
                fresh[p, e, place][0] += 1
                fresh[p, e, place][1] += int(ints[k, p * 8 + place])
    assert got == {k: tuple(v) for k, v in fresh.items()}


def test_whitening(spark):
    data = rows(200, dims=20)
    got = whitening.whiten(frame(spark, data)).collect()
    x = [tuple(math.floor(Fraction(c) * 64) + 1_000_000 for c in v) for _, v, _ in kept(data)]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(20)] for i in range(20)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n}
    want = defaultdict(list)
    for (i, _, _), v in zip(kept(data), x, strict=True):
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)])
        want[i].append((sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), centred @ axes[:, :16] / np.sqrt(values[:16])))
    z = defaultdict(list)
    for r in got:
        z[r.vec_id].append(r)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9
    sign = {}
    for i, vectors in want.items():
        for c in range(16):
            mine = sorted((int(r.deviation), r.whitened) for r in z[i] if r.component == c + 1)
            assert [d for d, _ in mine] == sorted(d for d, _ in vectors)
            if len(vectors) == 1 and abs(vectors[0][1][c]) > 1e-6:
                sign.setdefault(c, np.sign(mine[0][1] / vectors[0][1][c]))
                assert mine[0][1] == pytest.approx(sign[c] * vectors[0][1][c], rel=1e-7, abs=1e-7)


def test_scatter_is_exact_whatever_the_shift(spark):
    rng = np.random.default_rng(1)
    x = [[int(c) for c in v] for v in rng.integers(2**31 - 10**6, 2**31, (50, 3))]
    df = spark.createDataFrame([(v,) for v in x], "x array<bigint>").repartition(4)
    n, s = 50, [sum(c) for c in zip(*x, strict=True)]
    want = [[n * sum(v[i] * v[j] for v in x) - s[i] * s[j] for j in range(3)] for i in range(3)]
    for shift in ([0, 0, 0], x[0], [-(2**31), 5, 2**31]):  # the first takes sums beyond 2^63
        got = whitening.scatter(df, "x", shift)
        assert got == (n, [a - n * b for a, b in zip(s, shift, strict=True)], want)
    assert sum(v << (40 * k) for k, v in enumerate(whitening._limbs(-(3**90)))) == -(3**90)


def test_whitening_without_directions(spark):
    flat = [(i, [0.25, -3.0], 1) for i in range(9)]
    for data in ([], [(7, None, 1)], flat):
        got = whitening.whiten(frame(spark, data))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = [(i, [float(i), float(2 * i), 1.0], 1) for i in range(9)]  # one direction only
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1.0)
    with pytest.raises(ValueError, match="differ"):
        whitening.whiten(frame(spark, [(1, [0.5], 1), (2, [0.5, 1.0], 1)]))


def searched(data, k, step):
    use = sorted({(i, tuple(c + 0.0 for c in v)) for i, v, _ in kept(data) if i is not None and any(v)})
    dist = lambda a, b: math.sqrt(math.fsum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    out = Counter()
    for q, v in use:
        if q % step == 0:
            best = sorted((dist(v, w), c) for c, w in use if c != q)[:k]
            out.update((q, n, c, round(d, 9)) for n, (d, c) in enumerate(best, 1))
    return out


@pytest.mark.parametrize(("k", "step", "cell"), [(10, 100, 1 << 26), (3, 5, 1), (400, 20, 1 << 26)])
def test_nearest(spark, monkeypatch, k, step, cell):
    data = rows(600, dims=32)  # cell=1: slices and groups of 256 rows
    monkeypatch.setattr(nearest, "TILE", 64)
    got = nearest.search(frame(spark, data, 7), F.col("vec_id") % step == 0, k=k, cell_bytes=cell)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()) == searched(data, k, step)


def test_nearest_few_rows(spark):
    assert nearest.search(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert nearest.search(frame(spark, [(100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (5, [0.0, -0.0], 1)]), F.col("vec_id") % 100 == 0).collect() == []
    got = nearest.search(frame(spark, [(100, [3.0, 4.0], 1), (3, [0.0, 8.0], 1), (2, [6.0, 0.0], 1), (None, [3.0, 4.0], 1)]), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(100, 1, 2, 5.0), (100, 2, 3, 5.0)]
    with pytest.raises(ValueError, match="differ"):
        nearest.search(frame(spark, [(1, [0.5], 1), (2, [0.5, 1.0], 1)]), F.lit(True))


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(2)
    for spread in (1e-30, 1.0, 1e15):
        a, b = rng.normal(0, spread, (50, 48)), rng.normal(0, spread, (70, 48))
        b[:20] = a[:20] * (1 + 1e-9)
        a[0], b[0] = 0, 0
        low, high = nearest.bounds(nearest.quantised(a), nearest.quantised(b))
        true = np.sqrt(((a[:, None] - b) ** 2).sum(2))
        assert (low <= true).all() and (true <= high).all()
