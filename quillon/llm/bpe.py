"""Byte-level BPE by ranks, with a segment tree over byte positions.

A piece of n bytes starts as n tokens. Leaf i of the tree holds the rank of the pair that starts at byte
i (none: infinity) together with i, so the root holds the leftmost pair of minimum rank. A merge joins
the token at that byte with its right neighbour in a doubly linked list, and updates three leaves (the
merged token's pair, the left neighbour's pair, the swallowed token's) in logarithmic time each: long
pieces cost n log n.

Each task keeps a bounded memo of pieces; a miss runs the tree, so the memo never changes a result. The
ranks are read where the task runs, from the path that is given.

Defined results: null and empty texts have no tokens; lone surrogates can't occur in Spark strings;
null identifiers and repeated rows pass through; a very long text, or a single very long piece of one, costs
n log n and is held once by its task; other columns aren't read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 62
MEMO = 1 << 19  # pieces, and words
LONGEST = 64  # code points of one that stays in the memo
GAP = re.compile(r" (?:\s|\Z)")  # a space before white space, or at the end
SHORT = (4, 8, 16, 32, 64)  # leaves of the trees that are run side by side; longer pieces get a tree of their own
SIZE = [next(x for x in SHORT if n <= x) for n in range(SHORT[-1] + 1)]
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id bigint, ids array<int>"


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.memo: dict[str, str] = {}  # tokens of pieces
        self.words: dict[str, str] = {}  # tokens of words after a space
        of_byte = [ranks.get(bytes([x]), -1) for x in range(256)]
        if -1 in of_byte:
            raise ValueError("a byte has no rank")
        if max(self.bytes_of) >= 1 << 25:
            raise ValueError("the ranks don't fit beside a position in 31 bits")
        self.of_byte = np.array(of_byte, np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.pairs, self.rank_of_pair = np.append(keys, NONE), np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), -1)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @staticmethod
    @lru_cache(2)
    def kept(path: str, pattern: str) -> Codec:
        """Loaded once, and kept for the next task of the same process."""
        return Codec.load(path, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        size = 1 << max(1, (n - 1).bit_length())
        shift, mask = size.bit_length(), (1 << size.bit_length()) - 1
        tree = [NONE] * (2 * size)
        end = list(range(1, n + 1))  # of the token that starts at byte i
        prev = list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int, value: int) -> None:
            k = size + i
            while k and tree[k] != value:
                tree[k] = value
                k >>= 1
                if k:
                    value = min(tree[2 * k], tree[2 * k + 1])

        def pair(i: int) -> int:
            """The leaf of the token at byte i with its right neighbour."""
            if (j := end[i]) >= n or (r := ranks.get(piece[i : end[j]])) is None:
                return NONE
            return r << shift | i

        while (top := tree[1]) != NONE:
            i = top & mask
            j = end[i]
            end[i] = end[j]
            if end[j] < n:
                prev[end[j]] = i
            update(j, NONE)
            update(i, pair(i))
            if (p := prev[i]) >= 0:
                update(p, pair(p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where a pair doesn't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.rank_of_pair[at], -1)

    def merge_side_by_side(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """The same as merge for many pieces of at most `size` bytes, a power of two: each has its tree, all take a step at a time."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(-1, size)
        wide, col = size + 1, np.arange(size)
        token = np.zeros((len(pieces), wide), np.int64)
        token[:, :size] = self.of_byte[raw]
        alive = col[None, :] < n[:, None]
        end = np.tile(np.arange(1, wide + 1), (len(pieces), 1))
        prev = end - 2
        none = np.int32(2**31 - 1)
        tree = np.full((len(pieces), 2 * size), none, np.int32)
        both = np.flatnonzero(alive[:, 1:].ravel())  # pairs of neighbouring bytes
        r, c = both // (size - 1), both % (size - 1)
        rank = self._rank(token[r, c], token[r, c + 1])
        tree[r, size + c] = np.where(rank >= 0, rank << 6 | c, none)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        token, end, prev, flat, live = token.ravel(), end.ravel(), prev.ravel(), tree.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[:, 1] != none)
        while len(rows):
            base, own = rows * (2 * size), rows * wide
            top = flat[base + 1]
            i = top & 63
            j = end[own + i]
            k = end[own + j]
            token[own + i], end[own + i], live[rows * size + j] = top >> 6, k, False
            last = np.minimum(k, size)
            prev[own + last] = i
            p = prev[own + i]
            left = p >= 0
            # Three leaves of each tree change: the swallowed token's, the merged token's, its left neighbour's.
            here = token[own + i]
            after = np.where(k < n[rows], self._rank(here, token[own + last]), -1)
            before = self._rank(token[(own + p)[left]], here[left])
            base = np.concatenate([base, base, base[left]])
            at = size + np.concatenate([j, i, p[left]])
            flat[base + at] = np.concatenate([np.full(len(rows), none), np.where(after >= 0, after << 6 | i, none), np.where(before >= 0, before << 6 | p[left], none)])
            while at[0] > 1:
                at >>= 1
                below = base + 2 * at
                flat[base + at] = np.minimum(flat[below], flat[below + 1])
            rows = rows[flat[rows * (2 * size) + 1] != none]
        kept = live.reshape(-1, size)
        ids, ends = token.reshape(-1, wide)[:, :size][kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Adds the tokens of each piece to the memo, as decimal numbers with a space before each."""
        by_size: dict[int, list[tuple[str, bytes]]] = {size: [] for size in SHORT}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.memo[p] = f" {whole}"
            elif size := SIZE[len(raw)] if len(raw) <= SHORT[-1] else 0:
                by_size[size].append((p, raw))
            else:
                self.memo[p] = "".join([f" {i}" for i in self.merge(raw)])
        for size, found in by_size.items():
            for lo in range(0, len(found), 4096):
                part = found[lo : lo + 4096]
                for (p, _), ids in zip(part, self.merge_side_by_side([x for _, x in part], size), strict=True):
                    self.memo[p] = "".join([f" {i}" for i in ids])

    def numbers(self, texts: list[str]) -> list[str]:
        """The tokens of each text as decimal numbers joined by one space.

        The pattern always starts a match at a space before a visible character, so a text whose spaces all
        stand there is taken word by word, each word with its space; any other text is matched as a whole.
        """
        for memo in (self.memo, self.words):
            if len(memo) > MEMO:
                memo.clear()
        parts = []
        for x in texts:
            head, *rest = x.split(" ")
            parts.append((x, []) if GAP.search(x) else (head, rest))
        missing = set(chain.from_iterable(rest for _, rest in parts)).difference(self.words)
        new = {w: self.find(" " + w) for w in missing}
        heads = [self.find(head) for head, _ in parts]
        self.learn({p for x in (*heads, *new.values()) for p in x if p not in self.memo})
        known = self.memo.__getitem__
        self.words.update((w, "".join(map(known, x))) for w, x in new.items())
        out = ["".join(map(known, x)) + "".join(map(self.words.__getitem__, rest)) for x, (_, rest) in zip(heads, parts, strict=True)]
        for memo, long in ((self.words, new), (self.memo, chain.from_iterable(heads)), (self.memo, chain.from_iterable(new.values()))):
            for p in [p for p in long if len(p) > LONGEST]:
                memo.pop(p, None)
        return [x[1:] for x in out]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.fromstring(x, np.int64, sep=" ").tolist() if x else [] for x in self.numbers(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.kept(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for doc, numbers in zip(part.column(0).to_pylist(), codec.numbers([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids = np.fromstring(numbers, np.int64, sep=" ").tolist() if numbers else []
                    rows.append((doc, len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.kept(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = codec.encode_batch([x or "" for x in part.column(1).to_pylist()])
                if ids:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row. No shuffle."""
    return _rows(docs, id_col, text_col).mapInArrow(_ids(path, pattern), ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of the ids; a null or empty list gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.kept(path, pattern)
        for batch in batches:
            data = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes the ids again: n_tokens and the digests of both. No shuffle."""
    return _rows(docs, id_col, text_col).mapInArrow(_digests(path, pattern), SCHEMA)
