"""Product codes of vectors by Lloyd's iterations in whole numbers, maintained by deltas.

Components become floor(scale * x); a vector is cut into `parts` equal parts, each with a codebook of
`entries` that starts as the parts of the smallest identifiers. A round assigns every part to its nearest
entry and replaces each entry by floor(sum / count) of its parts.

One pass of a round reads the rows with their assignments of the round before, assigns anew, and writes the
rows with the new assignments. Into the same table each task writes what changed, summed: for each
(part, entry) the count and the integer sums of the parts that came, less those that left. Only these rows,
parts * entries of them a task at most, are shuffled and added to the running sums, which are a table of
parts * entries * width integers. The first round is a change from nothing. All arithmetic is exact: in
doubles where 2^53 isn't reached, in Python's integers otherwise. The driver holds codebooks only, whose
size is a parameter times the dimension.

Defined results: rows whose vector is null or empty, or holds null or non-finite components, go. Rows
without identifier are coded like others and start a codebook after all others only; repeated identifiers
count by row, ties among the first by components. Equal distances go to the lower entry; an entry without
parts stays; with fewer rows than entries the codebooks are smaller. Null labels are one group. Vectors of
different length, a length that `parts` doesn't divide, and components beyond 2^31 / scale raise. An empty
table gives an empty result, whose digest is that of no component. Other columns aren't read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import Scratch
from quillon.llm._vectors import dimension, exact, integers, matrix, usable

STATE = "vec_id bigint, label {label}, ints array<bigint>, code binary, error bigint, part int, entry int, n bigint, total array<bigint>"


def _nearest(x: np.ndarray, book: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest of equals, and the squared distance."""
    a, b = (exact(v, 4 * x.shape[1], most) for v in (x, book))
    far = (b * b).sum(1) - 2 * a.dot(b.T)
    code = far.argmin(1)
    return code, (a * a).sum(1) + far[np.arange(len(a)), code]


def _round(books: np.ndarray, deltas: bool):
    """Rows (vec_id, label, ints, code before) assigned to `books` (parts, entries, width); with `deltas` also what changed."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ints = matrix(batch.column(2), parts * width)
            most = max(int(np.abs(ints).max()), int(np.abs(books).max()))
            code, error = np.empty((n, parts), np.uint8), 0
            for p in range(parts):
                code[:, p], d = _nearest(ints[:, p * width : (p + 1) * width], books[p], most)
                error = error + (d.astype(np.int64) if d.dtype != object else d)
            if deltas:
                known = np.array([c is not None for c in batch.column(3).to_pylist()])
                was = np.frombuffer(b"".join(c or bytes(parts) for c in batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                changed = (code != was) | ~known[:, None]
                for p in range(parts):
                    x = ints[:, p * width : (p + 1) * width]
                    for rows, entry, sign in ((changed[:, p], code, 1), (changed[:, p] & known, was, -1)):
                        np.add.at(count[p], entry[rows, p], sign)
                        np.add.at(total[p], entry[rows, p], sign * x[rows])
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            kept = [batch.column(0), batch.column(1), batch.column(2) if deltas else pa.nulls(n, pa.list_(pa.int64())), codes, pa.array(error.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)
            label = batch.column(1).type
        part, entry = np.nonzero((count != 0) | (total != 0).any(2))
        if len(part):
            empty = [pa.nulls(len(part), t) for t in (pa.int64(), label, pa.list_(pa.int64()), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=NAMES)

    return run


NAMES = ["vec_id", "label", "ints", "code", "error", "part", "entry", "n", "total"]


def _running(before: DataFrame | None, step: DataFrame) -> DataFrame:
    """The sums (part, entry, place, n, total) so far with the changes of a round."""
    change = step.where("part is not null").select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
    rows = change if before is None else before.select(change.columns).unionByName(change)
    return rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Codebooks with each used entry at floor(sum / count)."""
    books = books.copy()
    for r in sums.where("n > 0").collect():  # parts * entries * width numbers at most
        books[r.part, r.entry, r.place] = r.total // r.n
    return books


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each kept row."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark: SparkSession = vectors.sparkSession
    keep = usable(vectors, vector_col, vec_id=F.col(id_col).cast("bigint"), label=F.col(label_col))
    rows = keep.select("vec_id", "label", integers(scale).alias("ints"), F.lit(None).cast("binary").alias("code"))
    dims = dimension(rows, "ints")
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    first = [r.ints for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, -1).swapaxes(0, 1) if first else np.zeros((parts, 0, 0), np.int64)
    state = STATE.format(label=rows.schema["label"].dataType.simpleString())
    work, sums = Scratch(spark, "codes-rounds"), None
    for k in range(rounds if first else 0):
        step = work.written(rows.mapInArrow(_round(books, True), state), f"assigned{k}")
        sums = work.written(_running(sums, step), f"sums{k}")
        books = _moved(books, sums)
        rows = step.where("part is null").select("vec_id", "label", "ints", "code")
    last = Scratch(spark, "codes").written(rows.mapInArrow(_round(books, False), state).select("vec_id", "label", "code", "error"), "final")
    work.drop()
    by_label = Scratch(spark, "codes").written(last.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = last.alias("a").join(by_label.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
