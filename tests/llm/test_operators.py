"""Brute-force checks of the operators that have no test file of their own, with the edge cases each docstring defines."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, line_dedup, media, packing, token_counts, toxicity, warc

SCHEMA = "doc_id bigint, text string, source string, n bigint, row bigint, keep string"
WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    (4, "One line of text\nshort\n  A LONG repeated line \nOne line of text", "a"), (2, "a long repeated line\nother words here\n\n", "a"), (9, "a long REPEATED line\n", None), (7, None, "b"), (8, "", "b"),
    (None, "a long repeated line\nonly without id", "a"), (3, "x" * 30_000 + " ünïcode 漢字 🙂 <|endoftext|> 12.5%  \t tab", "b"), (9, "same id, other text\na long repeated line", "c"), (9, "same id, other text\na long repeated line", "c"), (11, "no\x1cbreak\x85here nor here, but long", "a"),
]


def frame(spark, rows=TEXTS, parts=3):
    return spark.createDataFrame([(i, t, s, 1, 2, "k") for i, t, s in rows], SCHEMA).repartition(parts)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(spark):
    big = 2**63 - 1
    owner = {}
    for i, t, _ in TEXTS:
        for k in map(key, (t or "").split("\n")):
            owner.setdefault(k, set()).add(big if i is None else i)
    want = []
    for i, t, _ in TEXTS:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or (big if i is None else i) == min(owner[key(x)])]
        want.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    for parts in (1, 5):
        out = line_dedup.dedup_lines(frame(spark, parts=parts).withColumn("Hash", F.lit("own")), counts=("lines", "n_dropped"))
        assert set(out.columns) == {*frame(spark).columns, "Hash", "lines", "n_dropped"}
        assert sorted(((r["doc_id"], r["text"], r["lines"], r["n_dropped"]) for r in out.collect()), key=str) == sorted(want, key=str)
        assert {(r["Hash"], r["keep"]) for r in out.collect()} == {("own", "k")}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_a_hash_over_many_partitions():
    summary = [(0, 1, 1, 5, 5, 10), (1, 5, 5, 5, 5, 20), (2, 5, 5, 9, 9, 3), (4, 9, 9, 9, 9, 7), (5, 10, 0, 11, 0, 1)]
    assert line_dedup.carried(summary) == {1: (5, 5, 10), 2: (5, 5, 10), 4: (9, 9, 3)}


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 2000
    rows = [(1, "http://a/1", long), (5, "http://a/5", long), (3, None, long), (2, "http://a/ 2\r\n", "small"), (4, "u", "small"), (6, "u", None), (None, "u", long), (7, "u", "x" * 300_000), (5, "http://a/5", long)]
    pages = spark.createDataFrame([(*r, "X") for r in rows], "page_id bigint, url string, html string, key string").repartition(3)
    got = warc.round_trip(pages, roll_bytes=400)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = max(j for j, _, g in rows if g == h and j is not None) if len(data) >= 1000 else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if last == i else "revisit", None if last == i else last))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_page").collect()), key=str) == sorted(want, key=str)
    assert all(r["payload"] == (dict((i, h) for i, _, h in rows)[r["page_id"]] or "").encode() for r in got.collect() if r["record_type"] == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_is_deterministic_and_checked(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "y" * (i * 7)) for i in range(200)], "page_id bigint, url string, html string")
    a, b = (warc.write_warc(pages, f"file://{tmp_path}/{x}", roll_bytes=2000) for x in "ab")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 2
    assert not [p for p in (tmp_path / "a/archives").iterdir() if "tmp" in p.name]
    file = sorted((tmp_path / "a/archives").glob("*.gz"))[0]
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(Exception, match="isn't what the manifest lists|ends inside"):
        warc.read_warc(spark, f"file://{tmp_path}/a").collect()


def test_byte_bpe(spark):
    enc, codec = token_counts.encoding(RANKS, P.PATTERN), bpe.Codec.load(RANKS, P.PATTERN)
    rnd = random.Random(3)
    texts = [t or "" for _, t, _ in TEXTS] + ["".join(rnd.choice("ab  \n\té漢1'sx🙂ÀZ\x1c\x85²½_") for _ in range(rnd.randrange(200))) for _ in range(300)] + ["ab" * 5000, "a" * 70, " " * 50]
    assert codec.encode_batch(texts) == [enc.encode_ordinary(t) for t in texts]
    pieces = [p.encode() for t in texts for p in codec.find(t) if len(p.encode()) <= 64]
    assert [codec.merge(p) for p in pieces] == [i if (w := codec.ranks.get(p)) is None else [w] for p, i in zip(pieces, codec.merge_side_by_side(pieces, 64), strict=True)]
    got = bpe.round_trip(frame(spark), RANKS, P.PATTERN)
    want = [(i, len(e := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in TEXTS]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(frame(spark), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((r["doc_id"], bytes(r["data"])) for r in both.collect() if r["doc_id"]) == sorted((i, (t or "").encode()) for i, t, _ in TEXTS if i)
    assert bpe.round_trip(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_token_counts(spark):
    enc = token_counts.encoding(RANKS, P.PATTERN)
    want = sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t, _ in TEXTS), key=str)
    for options in ({}, {"block_tokens": 3}, {"block_tokens": 1}):
        got = token_counts.token_counts(frame(spark, parts=2), RANKS, P.PATTERN, **options)
        assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == want
    assert token_counts.token_counts(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_tokens_after_the_last_separator(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "tokens").mkdir()
    np.array([5, 50256, 7, 8, 9], "<u2").tofile(tmp_path / "tokens/x")
    np.array([1, 2], "<u2").tofile(tmp_path / "tokens/y")
    files = spark.createDataFrame([("x",), ("y",)], "file string")
    assert [tuple(r) for r in token_counts.scan_tokens(files, root, block_tokens=2).collect()] == [("x", 0, 1)]
    assert sorted(map(tuple, token_counts.unended(files, root, block_tokens=2).collect())) == [("x", 3), ("y", 2)]


def round_robin(rows, ids, window, targets):
    """Places of rows in the order in which the queues send them, window by window, with whole-number credits."""
    queues = defaultdict(list)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0)):
        queues[rows[k][2]].append(k)
    if targets is None:
        share = {s: Fraction(sum(len(ids[k]) for k in q), sum(map(len, ids))) for s, q in queues.items()}
    else:
        share = {s: Fraction(1, len(queues)) if targets == packing.EQUAL else Fraction(round(targets.get(s, 0) * packing.SCALE), packing.SCALE) for s in queues}
    order, sent, w, names = [], Counter(), 0, sorted(queues, key=lambda s: (s is not None, s or ""))
    while any(share[s] and queues[s] for s in names):
        for s in names:
            while share[s] and queues[s] and sent[s] + len(ids[queues[s][0]]) <= share[s] * window * (w + 1):
                order.append(queues[s].pop(0))
                sent[s] += len(ids[order[-1]])
        w += 1
    return order + [k for s in names for k in queues[s]]


def test_packing(spark):
    rnd = random.Random(5)
    rows = TEXTS + [(100 + k, " ".join(rnd.choice(["alpha", "beta", "Gamma,", "δέλτα", "x1", "ÀÉ'll", "İx", "a\u0301"]) for _ in range(rnd.randrange(1, 90))), rnd.choice("aaabc")) for k in range(150)]
    tok = Tokenizer.from_file(WORDS)
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows]
    for targets, length in ((None, 256), ({"a": 0.5, "b": 0.3, None: 0.1}, 256), (packing.EQUAL, 100), ({"zzz": 1.0, "b": 2.0}, 64)):
        pieces = sorted(packing.pack(frame(spark, rows), WORDS, length=length, targets=targets).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        at, found = 0, iter(pieces)
        for k in round_robin(rows, ids, length, targets):
            start = 0
            while start < len(ids[k]):
                r = next(found)
                want = np.array(ids[k][start : start + length - at % length], "<u4").tobytes()
                assert (r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"], r["doc_tokens"]) == (*divmod(at, length), rows[k][0], start, len(want) // 4, len(ids[k]))
                assert bytes(r["ids"]) == want and r["ids_crc32"] == zlib.crc32(want)
                start, at = start + len(want) // 4, at + len(want) // 4
        assert next(found, None) is None
    assert packing.pack(frame(spark, []), WORDS, targets=packing.EQUAL).count() == 0
    for bad in ({"a": -1.0}, {"a": 0.0}, {}):
        with pytest.raises(ValueError):
            packing.pack(frame(spark, rows), WORDS, targets=bad)


def test_packing_holds_the_targets_until_a_queue_is_dry(spark, tmp_path):
    rows = [(k, "alpha beta " * (3 + k % 5), "a" if k % 4 else "b") for k in range(400)]
    stored = packing.tokenized(frame(spark, rows), f"file://{tmp_path}", WORDS).cache()
    for targets in ({"a": 0.75, "b": 0.25}, {"a": 0.2, "b": 0.8}, packing.EQUAL):
        share = {"a": 0.5, "b": 0.5} if targets == packing.EQUAL else targets
        left = Counter(s for _, _, s in rows)
        sent, upto = Counter(), 0
        for r in sorted(packing.plan(stored, window=256, targets=targets).collect(), key=lambda r: r["at"]):
            assert r["at"] == upto
            upto, sent[r["source"]], left[r["source"]] = upto + r["n"], sent[r["source"]] + r["n"], left[r["source"]] - 1
            if all(left.values()):  # a deficit is at most a window's credit and a document
                assert all(abs(sent[s] - upto * share[s]) <= 256 + 20 for s in share)


def test_words_as_the_tokenizer():
    rnd, tok, words = random.Random(7), Tokenizer.from_file(WORDS), packing.Words(WORDS)
    texts = ["".join(rnd.choice("ab  \n\té漢1'sx🙂ÀZ\x1c\x85²½_ΣσςİıǅʼßẞÅǺ don't'LL.,;-<|\u0301") for _ in range(rnd.randrange(90))) for _ in range(3000)]
    assert words.encode(texts) == [np.asarray(e.ids, "<u2").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def cosine_hash(payload):
    """By the definition, sample by sample."""
    rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]

    def slices(n):
        return [range(k * n // 32, max((k + 1) * n // 32, k * n // 32 + 1)) for k in range(32)]

    small = [[sum(rows[y][x] for y in ys for x in xs) / len(ys) / len(xs) for xs in slices(64)] for ys in slices(len(rows))]
    wave = [[math.cos(math.pi * (2 * k + 1) * u / 64) for k in range(32)] for u in range(8)]
    half = [[sum(wave[u][x] * row[x] for x in range(32)) for u in range(8)] for row in small]
    low = [round(sum(wave[v][y] * half[y][u] for y in range(32)), 6) for v in range(8) for u in range(8)]
    middle = sum(sorted(low)[31:33]) / 2
    return f"{int(''.join('01'[x > middle] for x in low), 2):016x}"


def test_large_images_are_unfiltered_by_diagonals(monkeypatch):
    rng = np.random.default_rng(4)
    for step, high, wide in ((1, 300, 400), (3, 20, 31), (4, 7, 1)):
        lines = np.concatenate([rng.integers(0, 5, (high, 1)), rng.integers(0, 256, (high, wide * step))], axis=1).astype(np.uint8)
        lines[5 : high - 2, 0] = rng.integers(3, 5, max(0, high - 7))
        found = []
        for least in (0, 1 << 40):
            monkeypatch.setattr(media, "DIAGONAL", least)
            found.append(media._unfilter(lines, step))
        assert (found[0] == found[1]).all()


def test_png_media(spark):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_columns(frame(spark)).collect()}
    for i, t, _ in TEXTS:
        raw = (t or "").encode()
        r, pay = got[(i, len(raw))], raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert media.decode(r["media"]).tobytes() == pay and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and r["feature"] == cosine_hash(pay)
    assert media.media_columns(frame(spark, [])).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 7, 3)).astype(np.uint8)
    lines, above = [], np.zeros((7, 3), int)
    for y, row in enumerate(image.astype(int)):
        left, corner = np.vstack([np.zeros((1, 3), int), row[:-1]]), np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [np.zeros_like(row), left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][y % 5]
        lines.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    data = zlib.compress(b"".join(lines))
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + media._chunk(b"IDAT", data[:9]) + media._chunk(b"IDAT", data[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode(png) == image).all()
    for k in (10, 30, 60, len(png) - 1):
        with pytest.raises(ValueError):
            media.decode(png[:k] + bytes([png[k] ^ 1]) + png[k + 1 :])


def test_png_rows_are_filtered():
    rng, k = np.random.default_rng(2), np.arange(64)
    rows = [rng.integers(0, 4, 64), (k * 3) % 256, (k * 3) % 256, *[(5 * k + 7 * y + rng.integers(0, 3, 64)) % 256 for y in range(6)], *[np.frombuffer(b"some words of plain text " * 3, np.uint8)[y : y + 64] for y in range(4)]]
    payload = np.array(rows).astype(np.uint8).tobytes() + rng.integers(0, 256, 64 * 50).astype(np.uint8).tobytes()
    png = media.encode(payload)
    lines = np.frombuffer(zlib.decompress(png[41:-16]), np.uint8).reshape(-1, 65)
    assert set(lines[:, 0].tolist()) == {0, 1, 2, 3, 4} and media.decode(png).tobytes() == payload
    assert (np.abs(lines[:, 1:].view(np.int8).astype(int)).sum(axis=1) <= np.abs(np.frombuffer(payload, np.int8).reshape(-1, 64).astype(int)).sum(axis=1)).all()


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), {"low_quality": "1 - quality", "toxic": "toxic"})
    rows = toxicity.score(docs, chain).join(held.withColumnRenamed("toxic", "y"), "doc_id").collect()
    hit = sum(r["toxic"] and r["y"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) >= 0.9 and hit / sum(r["y"] for r in rows) >= 0.75
    assert all(0 <= r["p_toxic"] <= 1 for r in rows) and len(chain.links[1].earlier) == 1


def test_toxicity_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(frame(spark), empty, {"toxic": "toxic"})
    scored = toxicity.score(frame(spark), chain)
    assert scored.count() == len(TEXTS) and scored.where("toxic").count() == 0
    assert toxicity.keep_clean(frame(spark), chain).count() == len(TEXTS)
    some = spark.createDataFrame([(4, 1, 1), (2, None, 0), (4, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(frame(spark, []), toxicity.train(frame(spark), some, {"low": "1 - quality", "toxic": "toxic"})).count() == 0


def test_ranks_file():
    with open(RANKS, "rb") as f:
        assert sum(1 for x in f if base64.b64decode(x.split()[0])) == 50256


def test_chain_as_by_hand():
    """The chain fitted again: stems and chi-squared by loops, weights by plain gradient steps."""
    rnd = random.Random(11)
    pool = ["calm", "river", "stone", "garden", "morning", "paper", "window"]
    texts, labels = [], []
    for _ in range(160):
        low, bad = rnd.random() < 0.5, rnd.random() < 0.4
        own = rnd.choices(pool, k=6) + ["Spamword!"] * (low and rnd.random() < 0.9) + ["vile", "curse"][: 2 * (bad and rnd.random() < 0.95)]
        rnd.shuffle(own)
        texts.append(" ".join(own))
        labels.append((int(low), int(bad)))
    texts[5], labels[5] = texts[4], labels[4]
    y = np.array(labels)
    options = {"least": 5, "least_z": 5.0, "n_stems": 400}

    def stems(text):
        out = set()
        for w in text.split():
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w).strip(toxicity.PUNCTUATION)
            out |= {w + " "} | {w[:n] for n in (3, 4, 5, 6) if w and len(w) >= 3 for n in [min(n, len(w))]} if w else set()
        return out

    own = [stems(t) for t in texts]

    def chosen(rows, target):
        scores = {}
        for s in set().union(*(own[i] for i in rows)):
            a = sum(s in own[i] for i in rows if target[i])
            c = sum(s in own[i] for i in rows if not target[i])
            b, d = sum(target[i] for i in rows) - a, sum(1 - target[i] for i in rows) - c
            z = (a * d - b * c) * math.sqrt(len(rows) / max((a + b) * (c + d) * (a + c) * (b + d), 1))
            if a + c >= 5 and z >= 5.0:
                scores[s] = z
        out = []
        for s in sorted(scores, key=lambda s: (-scores[s], len(s), s)):
            if not any(t.startswith(s) or s.startswith(t) for t in out):
                out.append(s)
        return out

    def fitted(rows, target, before):
        """A function of a row and the earlier categories' probabilities."""
        names = chosen(rows, target)

        def features(i, b):
            return [float(s in own[i]) for s in names] + list(b) + [1.0]

        x, t = np.array([features(i, before[i]) for i in rows]), np.array([target[i] for i in rows], float)
        w, ridge = np.zeros(x.shape[1]), np.array([0.3] * (x.shape[1] - 1) + [1e-6])
        for _ in range(30_000):
            w += 0.004 * (x.T @ (t - 1 / (1 + np.exp(-(x @ w)))) - ridge * w)
        return lambda i, b: 1 / (1 + math.exp(-float(np.array(features(i, b)) @ w)))

    every, fold = range(len(texts)), [zlib.crc32(t.encode()) % 5 for t in texts]
    before, given = [[] for _ in texts], [[] for _ in texts]  # out of fold; by the whole model, which scoring feeds on
    for k in (0, 1):
        target = y[:, k].tolist()
        parts = [fitted([i for i in every if fold[i] != f], target, before) for f in range(5)]
        whole = fitted(every, target, before)
        given = [[*g, whole(i, g)] for i, g in enumerate(given)]
        before = [[*b, parts[fold[i]](i, b)] for i, b in enumerate(before)]
    chain = toxicity.fit_chain(texts, y, ["low", "bad"], **options)
    got = [chain.score(t) for t in texts]
    assert np.abs(np.array(got) - np.array(given)).max() < 1e-3 and fold[4] == fold[5]
    for k in (0, 1):
        assert set(chain.links[k].weights) == set(chosen(every, y[:, k].tolist()))
    last = sorted({b[1] for b in before}, reverse=True)
    f1 = {p: 2 * sum(y[i, 1] for i in every if before[i][1] >= p) / (sum(b[1] >= p for b in before) + y[:, 1].sum()) for p in last}
    best = max(last, key=lambda p: (f1[p], p))
    below = [p for p in last if p < best][0]
    assert chain.threshold == pytest.approx(max(0.2, (best + below) / 2), abs=1e-3)
