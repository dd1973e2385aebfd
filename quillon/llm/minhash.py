"""Near-duplicate detection by circulant MinHash with exact verification.

Two permutations of the 32-bit numbers make a signature: sigma shuffles the hashes of a document's
shingles once; coordinate k is the least pi(sigma(x) - k), the second permutation shifted circularly by k.
With 200 coordinates in 40 bands of 5, two sets of similarity 0.8 share a band but for 1.3e-7 of cases.

Steps:

1. Documents with the same words form a class (by a cryptographic hash of all words); a hot group of copies
   is one row from here on.
2. (bucket, document) rows are range-partitioned and streamed; a hot bucket spreads over partitions. Within
   a bucket the documents whose signatures agree, within five and a half standard deviations of the
   threshold, are joined; buckets too large for a block are joined as a whole, which can only add to step 4.
3. The components of these edges are families: any two documents to be linked are in one family.
4. The texts of families are moved once. A task holds a block of a family, numbers its shingles without
   hashing, counts all intersections by an inverted index, and gives only links that join components:
   fewer than the block has documents, however many pairs are similar or nearly so. Of families of
   several blocks, documents outside the largest component then meet the other blocks too, two blocks at a
   time: first by signatures and sizes, then, of what these allow, by full sets.
5. Components of the links, by repeated hooking to the smallest neighbour.

So no pairs of a bucket or family are emitted or shuffled, none is capped, and no links or components reach the
driver; no task holds more than two blocks. A family of m documents below the threshold still costs
m * m / 2 comparisons inside its blocks and between them, and the texts that signatures allow are moved once
a pair of blocks.

Defined results: null and empty texts (or white space only) have an empty set, are linked with nothing
and are their own component; a text of fewer words than `words` is one shingle; rows that repeat an
identifier are one node of the graph, and each gets a row; null identifiers are linked with nothing
and have a null component (kept: true); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import Scratch, fresh, written

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
DEVIATIONS = 5.5
BLOCK = 1024  # members of a bucket that are compared by signatures; larger ones count as alike
MEMBERS, SHINGLES = 2048, 1 << 20  # of a block of a family that a task holds at a time
SIGNED = "id bigint, n bigint, class binary, bands array<bigint>, signature binary"


def split_words(text: str) -> list[bytes]:
    """A-Z lower-cased; split at ASCII white space."""
    return text.encode().lower().split()


def shingle_set(text: str, size: int) -> set[bytes]:
    """The exact set: shingles as words joined by one space."""
    words = split_words(text)
    if not words:
        return set()
    if len(words) < size:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """64-bit hashes of all shingles, from hashes of words, and the exact number of distinct ones."""
    place: dict[bytes, int] = {}
    own = np.fromiter([place.setdefault(w, len(place)) for w in words], np.int64, len(words))
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
    width = min(size, len(words))
    n = len(words) - width + 1
    if len(place) ** width < 2**63:
        key = np.zeros(n, np.int64)
        for i in range(width):
            key = key * len(place) + own[i : i + n]
        key.sort()
        distinct = 1 + int(np.count_nonzero(key[1:] != key[:-1]))
    else:
        distinct = np.unique(np.stack([own[i : i + n] for i in range(width)]), axis=1).shape[1]
    each, out = of_word[own], np.full(n, width, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return out, distinct


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _permute(x: np.ndarray, odd_a: int, odd_b: int, spare: np.ndarray | None = None) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: each step can be undone."""
    spare = np.empty_like(x) if spare is None else spare
    x ^= np.right_shift(x, np.uint32(16), out=spare)
    x *= np.uint32(odd_a)
    x ^= np.right_shift(x, np.uint32(15), out=spare)
    x *= np.uint32(odd_b)
    x ^= np.right_shift(x, np.uint32(16), out=spare)
    return x


_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]
_SLAB = 256  # shingles: a slab of them with all shifts stays in the cache


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a set that isn't empty."""
    base = _permute((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(base), _SLAB):
        x = base[None, lo : lo + _SLAB] - _SHIFTS
        np.minimum(out, _permute(x, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """A row of buckets for each row of coordinates."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i] + np.uint64(1))
    return mix64(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                split = [split_words(x or "") for x in part.column(1).to_pylist()]
                signed = [shingle_hashes(x, size) if x else (None, 0) for x in split]
                coordinates = np.stack([np.zeros(COORDINATES, np.uint32) if h is None else signature(h) for h, _ in signed])
                low = (coordinates & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for _, n in signed], pa.int64()),
                        pa.array([blake2b(b" ".join(x), digest_size=16).digest() if x else None for x in split], pa.binary()),
                        pa.array([b if x else None for b, x in zip(bands_of(coordinates), split, strict=True)], pa.list_(pa.int64())),
                        pa.array([c.tobytes() if x else None for c, x in zip(low, split, strict=True)], pa.binary()),
                    ],
                    names=["id", "n", "class", "bands", "signature"],
                )

    return run


def least_agreement(threshold: float) -> int:
    """Coordinates that two sets at the threshold share at least, with bytes for coordinates."""
    p = threshold + (1 - threshold) / 256
    return int(np.floor(COORDINATES * p - DEVIATIONS * np.sqrt(COORDINATES * p * (1 - p))))


class Forest:
    """Sets of places 0..n-1 that are joined one by one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _buckets(block: int):
    """Of rows (bucket, id) sorted by both: the buckets with several members.

    kind 0: the members of a bucket, `block` of them at most. Larger buckets, and those that touch an end of
    the partition and may go on beyond it, are taken as alike as a whole: kind 1, pairs of their first
    member with each other one; kind 2, a bucket and its first member here, to join its parts.
    """
    names, types = ("kind", "bucket", "a", "b", "ids"), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, first, whole, rows = None, [], None, True, []

        def close(at_end: bool) -> None:
            nonlocal whole
            if bucket is not None:
                if whole or at_end:
                    spill()
                    rows.append((2, bucket, first, None, None))
                elif len(held) > 1:
                    rows.append((0, None, None, None, held))
            whole = False

        def spill() -> None:
            rows.extend((1, None, first, x, None) for x in held if x != first)
            held.clear()

        for batch in batches:
            own, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(own):
                continue
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ends = np.append(starts[1:], len(own))
            # Whole runs of one row say nothing; the batch's first and last run may go on in others.
            told = ends - starts > 1
            told[[0, -1]] = True
            for lo, hi in zip(starts[told].tolist(), ends[told].tolist(), strict=True):
                if bucket is None or own[lo] != bucket:
                    starts_here = bucket is None
                    close(False)
                    bucket, first, held, whole = int(own[lo]), int(ids[lo]), [], starts_here
                held.extend(ids[lo:hi].tolist())
                if len(held) > block:
                    whole = True
                if whole:
                    spill()
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows.clear()
        close(True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _grouped(of_group, columns: int, size: int = 1, names: tuple[str, ...] = ("a", "b")):
    """Streams rows sorted by their first `size` columns; of_group turns the rest of a group's rows into rows of integers, pairs (a, b) if nothing else is said."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
                if row[:size] != key:
                    out += of_group(rows) if rows else []
                    key, rows = row[:size], []
                rows.append(row[size:])
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        out += of_group(rows) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def alike(members: list[tuple[int, int, bytes]], least: int, percent: int) -> list[tuple[int, int]]:
    """Of (id, n, signature): edges that join the members whose signatures and sizes allow the threshold, directly or by way of others."""
    ids, n = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    sig = np.frombuffer(b"".join([m[2] for m in members]), np.uint8).reshape(-1, COORDINATES)
    left, edges = np.arange(len(members)), []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = ((sig[left] == sig[k]).sum(axis=1) >= least) & (100 * np.minimum(n[left], n[k]) >= percent * np.maximum(n[left], n[k]))
            queue += left[near].tolist()
            edges += [(int(ids[root]), x) for x in ids[left[near]].tolist() if x != ids[root]]
            left = left[~near]
    return edges


def numbered(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Of each list of words: numbers of its distinct shingles, equal only for equal shingles (no hashes)."""
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    width, number, room = 1, words, len(known) + 1
    while width < size:
        # number[i] stands for `width` words from i on; two of them, overlapping if need be, stand for up to twice as many.
        step = min(width, size - width)
        pair = number[:-step] * room + number[step:] if len(number) > step else np.zeros(0, np.int64)
        number = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width, room = width + step, len(number) + 1
    short: dict[tuple[bytes, ...], int] = {}
    out = []
    for t, lo, hi in zip(texts, (ends - lengths).tolist(), ends.tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(number[lo : hi - size + 1]))
        elif t:
            out.append(np.array([-1 - short.setdefault(tuple(t), len(short))], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def exact_links(rows: list[tuple[int, str]], size: int, percent: int) -> list[tuple[int, int]]:
    """Links by full sets between the rows (id, text) of a block.

    Only links that join what earlier links haven't are given: fewer than there are rows.
    """
    return _joining([(0, True, i, None, text) for i, text in rows], size, percent, across=False)


def cross_links(rows: list[tuple[int, bool, int, int, str]], size: int, percent: int) -> list[tuple[int, int]]:
    """Of two blocks' rows (side, outside, id, component, text): links by full sets between the sides, one end of them outside the largest component."""
    return _joining(rows, size, percent, across=True)


def _joining(rows: list[tuple[int, bool, int, int | None, str]], size: int, percent: int, across: bool) -> list[tuple[int, int]]:
    """Intersections come from an inverted index of the shingles, of the second side's if `across`."""
    sets = numbered([split_words(r[4]) for r in rows], size)
    ids, known = [r[2] for r in rows], {}
    forest, n = Forest(len(rows)), np.array([len(x) for x in sets], np.int64)
    for k, (_, _, _, component, _) in enumerate(rows):
        if component is not None:
            forest.join(k, known.setdefault(component, k))
    outside = np.array([r[1] for r in rows], bool)
    indexed = np.array([not across or r[0] == 1 for r in rows])
    inside = np.repeat(indexed, n)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(rows)), n)
    _, shingle = np.unique(shingle, return_inverse=True)
    held, place = shingle[inside], owner[inside]
    order = np.argsort(held, kind="stable")
    place = place[order]
    starts = np.searchsorted(held[order], np.arange(len(shingle) + 1 if not len(shingle) else int(shingle.max()) + 2))
    at, links = np.cumsum(n), []
    for k in range(len(rows)):
        if across and indexed[k]:
            continue
        own = shingle[at[k] - n[k] : at[k]]
        lists = [place[starts[x] : starts[x + 1]] for x in own.tolist()]
        if not lists:
            continue
        both = np.bincount(np.concatenate(lists), minlength=len(rows))
        found = np.flatnonzero((100 * both >= percent * (n + n[k] - both)) & (both > 0) & (outside | outside[k]))
        links += [(ids[k], ids[j]) for j in found.tolist() if j != k and forest.join(k, j) and ids[k] != ids[j]]
    return links


def may_link(rows: list[tuple[int, int, int, int, bool, int, int, int, bytes]], least: int, percent: int) -> list[tuple[int, ...]]:
    """Of two blocks' rows (family, lo, hi, side, outside, id, component, n, signature): those whose signature and size allow a link to the other side that joins components and has an end outside the largest."""
    side, outside = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], bool)
    component, n = np.array([r[6] for r in rows]), np.array([r[7] for r in rows])
    sig = np.frombuffer(b"".join([r[8] for r in rows]), np.uint8).reshape(-1, COORDINATES)
    other, keep = np.flatnonzero(side == 1), np.zeros(len(rows), bool)
    for k in np.flatnonzero(side == 0):
        near = other[(component[other] != component[k]) & (outside[other] | outside[k]) & (100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k]))]
        near = near[(sig[near] == sig[k]).sum(axis=1) >= least]
        keep[near] = True
        keep[k] = len(near) > 0
    return [(*r[:4], int(r[4]), *r[5:7]) for r, kept in zip(rows, keep.tolist(), strict=True) if kept]


FACING = ("family", "lo", "hi", "side", "outside", "id", "component")


def block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of families (family, block, blocks, outside and others) beside each other block of theirs, if the row or some row there is outside: family, lo, hi, side and the others.

    What has the same (family, lo, hi) is two blocks at most.
    """
    there = rows.where("outside").select("family", F.col("block").alias("other")).distinct().withColumn("met", F.lit(True))
    beside = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block").join(there, ["family", "other"], "left").where("outside OR met")
    return beside.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")}).drop("block", "blocks", "other", "met")


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest reachable id) of all ends of links (a, b) but the smallest ones themselves.

    Each round hooks every node to its smallest neighbour and then halves the paths; links whose ends
    share a label are dropped, so stars are done in a round or two. Joins and sums only, and each
    round is cut by written tables, whose counts also tell when to stop. What joins on a root that a third
    of all nodes hang on is the left side of left joins, which Spark splits where it is skewed.
    """
    work = Scratch(links.sparkSession, "components")
    edges = work.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    moved, n, n_moved = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0), edges.count(), 0
    while n:
        # Every root that has a smaller neighbour hooks to the smallest one; chains of hooks are halved until none is left.
        hook = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        while True:
            onward = hook.select(F.col("id").alias("to"), F.col("to").alias("next"))
            halved = work.written(hook.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("far")), "hook", n)
            hook = halved.select("id", "to")
            if halved.where("far").isEmpty():
                break
        end, n_moved = hook.select(F.col("id").alias("component"), F.col("to").alias("end")), n_moved + n
        moved = work.written(moved.join(end, "component", "left").select("id", F.coalesce("end", "component").alias("component")).unionByName(hook.withColumnRenamed("to", "component")), "moved", n_moved)
        a = edges.join(end.withColumnRenamed("component", "a"), "a", "left").select(F.coalesce("end", "a").alias("a"), "b")
        ab = a.join(end.withColumnRenamed("component", "b"), "b", "left").select("a", F.coalesce("end", "b").alias("b"))
        edges = work.written(ab.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", n)
        n = edges.count()
    out = Scratch(links.sparkSession, "components").written(moved, "components", n_moved)
    work.drop()
    return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, written to the shared folder; all else that it writes is removed."""
    spark = docs.sparkSession
    work = Scratch(spark, "minhash")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = work.written(own.mapInArrow(_sign(words), SIGNED), "signed")
    full = signed.where("class IS NOT NULL AND id IS NOT NULL")
    # A row a class: the same words are the same set, and only the smallest identifier goes on.
    classes = work.written(full.groupBy("class").agg(F.min("id").alias("id")), "classes")
    heads = work.written(full.select("id", "class", "n", "bands", "signature").join(classes, ["class", "id"], "left_semi").dropDuplicates(["id", "class"]), "heads")

    in_bands = heads.select(F.explode("bands").alias("bucket"), "id").repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    buckets = work.written(in_bands.mapInArrow(_buckets(BLOCK), "kind int, bucket bigint, a bigint, b bigint, ids array<bigint>"), "buckets")
    # The same members often share several buckets; they are looked at once.
    blocks = buckets.where("kind = 0").select("ids").distinct().select(F.xxhash64("ids").alias("block"), F.explode("ids").alias("id"))
    least = least_agreement(percent / 100)
    facing = blocks.join(heads.select("id", "n", "signature"), "id").select("block", "id", "n", "signature")
    edges = facing.repartition("block").sortWithinPartitions("block", "id").mapInArrow(_grouped(lambda rows: alike(rows, least, percent), 4), "a bigint, b bigint")
    parts = buckets.where("kind = 2").select("bucket", "a").distinct()
    firsts = parts.groupBy("bucket").agg(F.min("a").alias("b"))
    edges = edges.unionByName(buckets.where("kind = 1").select("a", "b")).unionByName(parts.join(firsts, "bucket").select("a", "b"))
    found = components(edges)
    roots = found.select("component").distinct()
    family = work.written(found.select("id", F.col("component").alias("family")).unionByName(roots.select(F.col("component").alias("id"), F.col("component").alias("family"))), "family")

    # Each family is one block if it isn't too large; its full sets are compared within the block.
    sizes = family.join(heads.select("id", "n"), "id").groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("blocks"))
    placed = family.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = work.written(own.join(placed, "id").dropDuplicates(["id", "text"]).select("id", "family", "block", "blocks", "text"), "texts")

    blocked = texts.select("family", "block", "id", "text").repartition("family", "block").sortWithinPartitions("family", "block", "id")
    links = work.written(blocked.mapInArrow(_grouped(lambda group: exact_links(group, words, percent), 4, 2), "a bigint, b bigint"), "links")
    # Rows that share an identifier but not a text are one node: the heads of their classes are linked through it.
    several = full.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("id")
    of_id = full.select("id", "class").join(several, "id").join(classes.withColumnRenamed("id", "head"), "class").select("id", "head").distinct()
    links = links.unionByName(of_id.join(of_id.groupBy("id").agg(F.min("head").alias("a")), "id").select("a", F.col("head").alias("b")).where("a <> b"))
    # Of a family of several blocks: who isn't in its largest component yet meets the other blocks too, a pair of blocks at a time, by signatures first.
    large = texts.where("blocks > 1")
    if not large.isEmpty():
        named = large.select("id", "family", "block", "blocks").distinct().join(components(links).withColumnRenamed("component", "to"), "id", "left").withColumn("component", F.coalesce("to", "id")).drop("to")
        named = work.written(named, "named")
        largest = named.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("largest"))
        placed = named.join(largest, "family").withColumn("outside", F.col("component") != F.col("largest")).drop("largest")
        met = block_pairs(placed.join(heads.select("id", "n", "signature"), "id")).select("family", "lo", "hi", *[F.col(c).alias(f"own_{c}") for c in FACING], "n", "signature")
        near = met.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "own_side", "own_id").mapInArrow(_grouped(lambda group: may_link(group, least, percent), 12, 3, FACING), ", ".join(f"{c} bigint" for c in FACING))
        rows = work.written(near.distinct(), "facing").join(large.select("id", "text"), "id").select("family", "lo", "hi", "side", F.col("outside").cast("boolean").alias("outside"), "id", "component", "text")
        rows = rows.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "side", "id")
        links = links.unionByName(work.written(rows.mapInArrow(_grouped(lambda group: cross_links(group, words, percent), 8, 3), "a bigint, b bigint"), "links"))
    moved = components(links)
    of_class = classes.join(moved, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    columns = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept")]
    rest = signed.where("class IS NULL OR id IS NULL").select("id", "n").withColumn("component", F.lit(None).cast("bigint"))
    out = written(full.select("id", "n", "class").join(of_class, "class").select("id", "n", "component").unionByName(rest).select(columns), "near_duplicates")
    work.drop()
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns as they are, whatever they are called."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("NOT kept").select("doc_id").distinct()
    gone = gone.toDF(*fresh(docs, "gone"))
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col(gone.columns[0]), "left_anti")
