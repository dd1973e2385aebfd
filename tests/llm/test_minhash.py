import itertools
import random

import pytest

from quillon.llm import minhash
from quillon.llm.minhash import keep_one, near_duplicates, shingle_set

SCHEMA = "doc_id bigint, text string, n bigint, class string, component string"


def brute(rows, size, percent):
    sets, ids = {}, sorted({r[0] for r in rows if r[0] is not None})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    own = [(i, shingle_set(t or "", size)) for i, t, *_ in rows]
    for (i, x), (j, y) in itertools.combinations(own, 2):
        if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    del sets
    return sorted(((i, len(x), i if i is None else top(i), i is None or top(i) == i) for i, x in own), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed=0, groups=6, members=30):
    rnd, rows, k = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([60, 120, 300]))]
        for _ in range(members):
            own = list(base)
            for _ in range(rnd.randrange(0, 6)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            rows.append((k, " ".join(own)))
            k += rnd.choice([1, 3])
    rnd.shuffle(rows)
    return rows


EDGES = [(None, "a b c d e f"), (None, None), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x" * 70_000 + " y z"), (907, "X" * 70_000 + " y  z"), (903, "one"), (908, "a\x1cb c d"), (909, "É é")]


@pytest.mark.parametrize("size", [4, 5])
def test_same_as_all_pairs(spark, size):
    rows = [(*r, 1, "c", None) for r in near_copies(size) + EDGES]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), words=size)
    assert result(got) == brute(rows, size, 80)


def test_small_blocks_of_large_families(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MEMBERS", 8)
    rows = [(*r, 1, "c", None) for r in near_copies(7, 2, 60)]
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), words=5)) == brute(rows, 5, 80)


def boilerplate(n=320, seed=4):
    """One family of documents that share much and stay below the threshold, but for twins far apart in it."""
    rnd = random.Random(seed)
    base, rows = " ".join(f"b{rnd.randrange(10**6)}" for _ in range(150)), []
    for i in range(n):
        own = [f"o{i % (n - 40)}x{j}" for j in range(24)] + [f"z{i}y{j}" for j in range(2)]  # the last 40 are twins of the first 40
        rows.append((i, f"{base} {' '.join(own)}"))
    rnd.shuffle(rows)
    return rows


def test_many_outsiders_meet_two_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "MEMBERS", 5)
    seen, plain = [], minhash.block_pairs

    def watched(rows):
        out = plain(rows)
        here = rows.groupBy("family", "block").count().agg({"count": "max"}).first()[0]
        pairs = out.groupBy("family", "lo", "hi").agg({"id": "count", "side": "max"}).collect()
        seen.append((rows.select("blocks").first()[0], here, max(r[3] for r in pairs), len(pairs)))
        return out

    monkeypatch.setattr(minhash, "block_pairs", watched)
    rows = [(*r, 1, "c", None) for r in boilerplate()]
    got = result(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), words=5))
    assert got == brute(rows, 5, 80)
    assert sum(not r[3] for r in got) == 40
    (blocks, largest_block, largest_pair, pairs), = seen
    assert blocks == 64 and largest_pair <= 2 * largest_block and pairs <= 64 * 63 // 2


def test_cross_links_join_sides_only():
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "p q r s t u"]
    rows = [(0, True, 1, 1, texts[0]), (0, True, 2, 2, texts[1]), (1, False, 3, 3, texts[2]), (1, True, 4, 4, texts[3])]
    assert minhash.cross_links(rows, 2, 80) == [(1, 3), (2, 3)]
    assert minhash.cross_links([(s, False, i, c, t) for s, _, i, c, t in rows], 2, 80) == []  # both ends in the largest component
    assert minhash.exact_links([(i, t) for _, _, i, _, t in rows], 2, 80) == [(1, 2), (1, 3)]


def test_keep_one_and_empty(spark):
    rows = [(*r, 1, "c", None) for r in EDGES]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "class", "component"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [900, 901, 902, 903, 903, 905, 906, 908, 909]
    empty = spark.createDataFrame([], SCHEMA)
    assert result(near_duplicates(empty)) == [] and keep_one(empty).count() == 0
