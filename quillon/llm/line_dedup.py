"""Line deduplication by range-partitioned hashes; the result is a compressed keep bitmap per document.

Every text is split at \\n. A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of at least `min_chars` code points that are in two or more documents lose all their lines except
in the smallest identifier that holds them.

One row per document and key is range-partitioned by (hash, document, position) and sorted within
partitions, so one frequent line spreads over many partitions. The first occurrence is found by streaming
each partition; for a hash that began in an earlier partition its owner is carried over from a summary of
one row a partition. Only hashes and positions are shuffled; the texts meet the bitmaps at the end. The
keys are written once, so that the bounds of the ranges and the shuffle both come from that table; all
tables but the bitmaps are removed at the end.

Defined results: null and empty texts are one empty line; null identifiers count as one document, the
same as identifier 2^63 - 1, which sorts after all others; rows with the same identifier count as one
document, and each keeps its own lines; an empty table gives an empty result. `apply_bitmaps` keeps all
other columns as they are, whatever they are called, but those named in `counts`, which it replaces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quillon.llm._common import Scratch, checkpointed, fresh, uncheckpointed, written

WHITE = b" \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1  # sorts last; stands for a null identifier
KEYS = "h bigint, h2 bigint, doc bigint, pos int, doc_hash binary, n_lines int, lines binary"
DROPS = "doc bigint, doc_hash binary, n_lines int, lines binary"


def line_keys(text: str, min_chars: int) -> tuple[dict[bytes, list[int]], int]:
    """The places of each key of at least min_chars code points, and the number of lines."""
    lines, at = text.encode().lower().split(b"\n"), {}  # bytes: A-Z only
    for i, line in enumerate(lines):
        key = line.strip(WHITE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            at.setdefault(key, []).append(i)
    return at, len(lines)


def doc_hash(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:16]


def _keys(min_chars: int):
    types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, digests = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at, n_lines = line_keys(text or "", min_chars)
                    if at:
                        of_doc = NO_ID if doc is None else doc, doc_hash(text)
                        for key, where in at.items():
                            digests.append(hashlib.blake2b(key, digest_size=16).digest())
                            rows.append((of_doc[0], where[0], of_doc[1], n_lines, where[0].to_bytes(4, "little") if len(where) == 1 else np.asarray(where, "<u4").tobytes()))
                if rows:
                    hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["h", "h2", "doc", "pos", "doc_hash", "n_lines", "lines"])

    return run


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents, and the start of each run of one hash."""
    h, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    return h, h2, doc, np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: its first hash, its last hash, and the document that first holds the last hash."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            h, h2, doc, starts = _runs(batch)
            first = first or (int(h[0]), int(h2[0]))
            s = starts[-1]
            if last is None or last[:2] != (int(h[s]), int(h2[s])):
                last = (int(h[s]), int(h2[s]), int(doc[s]))
    if last is not None:
        row = (TaskContext.get().partitionId(), *first, *last)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["part", "fh", "fh2", "h", "h2", "doc"])


def carried(summary: list[tuple[int, int, int, int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """By partition: the hash it goes on with, and that hash's owner in an earlier partition."""
    out, open_ = {}, None
    for part, fh, fh2, h, h2, doc in sorted(summary):
        if open_ and open_[:2] == (fh, fh2):
            out[part] = open_
            if (h, h2) == (fh, fh2):  # the whole partition holds that one hash
                continue
        open_ = (h, h2, doc)
    return out


def _later(carry: dict[int, tuple[int, int, int]]):
    """Streams the rows whose document isn't the first that holds the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = carry.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            h, h2, doc, starts = _runs(batch)
            owner = doc[starts].copy()
            if last and last[:2] == (int(h[0]), int(h2[0])):
                owner[0] = last[2]
            of_row = np.repeat(owner, np.diff(np.append(starts, len(h))))
            last = (int(h[-1]), int(h2[-1]), int(owner[-1]))
            if (drop := of_row != doc).any():
                yield batch.filter(pa.array(drop)).select(["doc", "doc_hash", "n_lines", "lines"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap for each run of rows of one document; the rows come sorted by document."""
    names = ("doc", "doc_hash", "n_lines", "n_dropped", "keep")
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    own, keep, rows = None, None, []

    def close() -> None:
        rows.append((*own, len(keep), int((~keep).sum()), zlib.compress(np.packbits(keep, bitorder="little").tobytes())))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows.clear()
        return out

    for batch in batches:
        for doc, doc_hash_, n, lines in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if own != (doc, doc_hash_):
                if own is not None:
                    close()
                own, keep = (doc, doc_hash_), np.ones(n, bool)
            keep[np.frombuffer(lines, "<u4")] = False
        if len(rows) > 4096:
            yield flush()
    if own is not None:
        close()
        yield flush()


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Of each document that loses lines: doc, doc_hash (of its text), n_lines, n_dropped, keep (zlib of a bit per line, first line first); a written table."""
    work = Scratch(docs.sparkSession, "lines")
    keys = work.written(docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(_keys(min_chars), KEYS), "keys")
    ranged = checkpointed(keys.repartitionByRange("h", "h2", "doc", "pos").sortWithinPartitions("h", "h2", "doc", "pos"))
    work.drop()
    summary = ranged.select("h", "h2", "doc").mapInArrow(_summary, "part bigint, fh bigint, fh2 bigint, h bigint, h2 bigint, doc bigint").collect()  # one row a partition
    drops = ranged.mapInArrow(_later(carried([tuple(r) for r in summary])), DROPS)

    by_doc = drops.repartition("doc", "doc_hash").sortWithinPartitions("doc", "doc_hash")
    out = written(by_doc.mapInArrow(_pack, "doc bigint, doc_hash binary, n_lines int, n_dropped int, keep binary"), "bitmaps")
    uncheckpointed(ranged)
    return out


def kept_lines(text: str | None, keep: bytes | None) -> str:
    lines = (text or "").split("\n")
    if keep is None:
        return "\n".join(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return "\n".join(compress(lines, bits.tolist()))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the kept text in text_col, and in the columns named by counts the lines before and those dropped.

    Rows without a bitmap pass unchanged; a null text that loses nothing is an empty one.
    """

    @F.pandas_udf("string")
    def keep(text, bits):
        import pandas as pd

        return pd.Series([kept_lines(x, b) for x, b in zip(text, bits, strict=True)])

    doc, own, n_dropped, bits = fresh(docs, "doc", "hash", "n_dropped", "keep", besides=counts or ())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    marks = bitmaps.select(F.col("doc").alias(doc), F.col("doc_hash").alias(own), F.col("n_dropped").cast("bigint").alias(n_dropped), F.col("keep").alias(bits))
    out = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), own: hashed}).join(marks, [doc, own], "left")
    more = {text_col: F.when(F.col(bits).isNull(), text).otherwise(keep(text, F.col(bits)))}
    if counts:
        n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        more |= {counts[0]: n_lines.cast("bigint"), counts[1]: F.coalesce(n_dropped, F.lit(0).cast("bigint"))}
    return out.withColumns(more).drop(doc, own, n_dropped, bits)


def dedup_lines(docs: DataFrame, *, counts: tuple[str, str] | None = None, **options) -> DataFrame:
    """docs with their texts reduced to the kept lines, and the counts asked for."""
    columns = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    return apply_bitmaps(docs, keep_bitmaps(docs, **options), counts=counts, **columns)
