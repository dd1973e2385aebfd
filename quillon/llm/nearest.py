"""Nearest neighbours by a block matrix join on quantised vectors with error bounds.

Candidates are dealt by hash into slices and queries into groups of a bounded number of rows; a cell, one
group with one slice, is one task's unit, met through a cogroup, so memory depends on the cell and not on
the data. In a cell every vector x becomes s * q with q in -127..127 (int8) and s its largest component over
127, and r = |x - s q| is kept. Tiles of the product of the q give the distance of two quantised vectors;
that of the vectors themselves lies within r_x + r_y of it. A candidate survives if its lower bound isn't
above the least of the k-th smallest upper bound of its tile and the k-th distance found so far. Survivors are
recomputed in doubles from the original vectors and merged into the k nearest of the cell. The lists of a
query from all slices then meet in one heap of k, which a task fills while it streams the sorted lists.

The tile product runs in single precision, whose results are whole numbers and exact below 2^24, or in
doubles for vectors of more than 1,040 components. No neighbour is lost: the bounds hold with slack for rounding, so the search is exact
although most distances are never computed in full.

Equal vectors are one as far as distances go: of the rows with one vector only the k + 1 smallest
identifiers can be among anybody's k nearest, and the others leave before cells are formed, within each task
first. A vector of a third of all rows is therefore k + 1 candidates.

Defined results: rows whose vector is null or empty, all zero, or holds null or non-finite components take no
part, nor do those without identifier, which couldn't be named. Rows are told apart by identifier: a query's
candidates are the rows of other identifiers, repeated rows count once, and an identifier with several
vectors is a candidate (or query) with each. Ties go to the smaller identifier. Vectors of different length
raise. An empty table gives an empty result; a query with no candidate gives no row. Other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import Scratch, written
from quillon.llm._vectors import dimension, matrix, usable

PAIRS = "query_id bigint, place int, vec_id bigint, score double"
NAMES = ["query_id", "place", "vec_id", "score"]
TILE = 1024
SLACK = 1e-11  # relative, far above the rounding of sums of doubles


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and norms of what the codes miss, not below the true ones."""
    scale = np.abs(x).max(1) / 127
    with np.errstate(divide="ignore", invalid="ignore"):
        codes = np.where(scale[:, None] > 0, np.rint(x / scale[:, None]), 0).clip(-127, 127).astype(np.int8)
    rest = x - scale[:, None] * codes
    return codes, scale, np.sqrt((rest * rest).sum(1)) * (1 + SLACK)


def bounds(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two quantised blocks, from one product of their codes."""
    (p, s, r), (q, t, u) = a, b
    kind = np.float32 if p.shape[1] * 127 * 127 < 2**24 else np.float64
    dots = (p.astype(kind) @ q.astype(kind).T).astype(np.float64)
    own, other = (((c.astype(np.int64) ** 2).sum(1) * k * k) for c, k in ((p, s), (q, t)))
    square, slack = own[:, None] + other - 2 * (s[:, None] * t) * dots, SLACK * (own[:, None] + other)
    gap = r[:, None] + u
    low, high = np.sqrt(np.maximum(square - slack, 0)) - gap, np.sqrt(np.maximum(square + slack, 0)) + gap
    return low * (1 - SLACK) - np.abs(low) * SLACK, high * (1 + SLACK)


def _cell(k: int, dims: int):
    """The k nearest of each query in a cell; left: query_id, place, vector; right: vec_id, vector."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        ids, places, names = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (left, "place"), (right, "vec_id")))
        if not len(ids) or not len(names):
            return pa.table({c: pa.array([], t) for c, t in zip(NAMES, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)})
        a, b = (matrix(t.column("vector").chunk(0), dims) for t in (left, right))
        best = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        codes = quantised(b)
        for lo in range(0, len(ids), TILE):
            rows = slice(lo, lo + TILE)
            own = quantised(a[rows])
            for at in range(0, len(names), TILE):
                cols = slice(at, at + TILE)
                low, high = bounds(own, tuple(x[cols] for x in codes))
                same = ids[rows, None] == names[cols]
                high[same] = np.inf
                limit = best[0][rows, -1]
                if high.shape[1] >= k:
                    limit = np.fmin(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(~(low > limit[:, None]) & ~same)  # a bound that overflowed keeps its pair
                _merge(best, k, lo, i, names[cols][j], _distances(a[rows], b[cols], i, j))
        i, j = np.nonzero(best[1] < np.iinfo(np.int64).max)
        return pa.table([pa.array(ids[i]), pa.array(places[i]), pa.array(best[1][i, j]), pa.array(best[0][i, j])], names=NAMES)

    return run


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        gap = a[i[lo : lo + (1 << 14)]] - b[j[lo : lo + (1 << 14)]]
        out[lo : lo + (1 << 14)] = np.sqrt((gap * gap).sum(1))
    return out


def _merge(best: tuple[np.ndarray, np.ndarray], k: int, lo: int, i: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
    """Puts found pairs (query row lo + i, name, score) into the k best of their rows, by (score, name)."""
    rows = np.unique(i)
    if not len(rows):
        return
    row = np.r_[np.repeat(rows, k), i]
    score, names = np.r_[best[0][lo + rows].ravel(), score], np.r_[best[1][lo + rows].ravel(), names]
    order = np.lexsort((names, score, row))
    row, score, names = row[order], score[order], names[order]
    first = np.searchsorted(row, rows)
    take = (first[:, None] + np.arange(k)).ravel()  # every row has k at least
    best[0][lo + rows], best[1][lo + rows] = score[take].reshape(-1, k), names[take].reshape(-1, k)


def _heaps(k: int):
    """Sorted by query: the k best (score, vec_id) of each, in one heap at a time, with their rank."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, float]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, float]] = []
        for (query, _), found in groupby(stream(batches), key=lambda r: r[:2]):
            out += [(query, n, name, score) for n, (score, name) in enumerate(heapq.nsmallest(k, ((r[3], r[2]) for r in found)), 1)]
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])


def _dealt(n: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def search(vectors: DataFrame, asked: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", cell_bytes: int = 1 << 26) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row for which `asked` (on column vec_id) holds, written to the shared folder."""
    spark = vectors.sparkSession
    rows = usable(vectors, vector_col, vec_id=F.col(id_col).cast("bigint")).where(F.col("vec_id").isNotNull())
    rows = rows.withColumn("vector", F.transform("vector", lambda c: c + F.lit(0.0))).where(F.exists("vector", lambda c: c != 0))  # -0.0 equals 0.0
    work = Scratch(spark, "nearest")
    once = work.written(rows.distinct(), "rows")
    alike = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    candidates = work.written(once.withColumn("nth", alike).where(F.col("nth") <= k + 1).drop("nth"), "candidates")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("vector")).cast("int")
    queries = once.where(asked).select(F.col("vec_id").alias("query_id"), place.alias("place"), "vector")
    dims = max(dimension(once, "vector"), 1)
    most = max(256, min(8192, cell_bytes // (8 * dims)))
    slices, groups = (max(1, -(-df.count() // most)) for df in (candidates, queries))
    left = queries.withColumn("grp", _dealt(groups, "query_id", "place")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = candidates.withColumn("slice", _dealt(slices, "vec_id", "vector")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("grp", "slice").cogroup(right.groupBy("grp", "slice")).applyInArrow(_cell(k, dims), PAIRS)
    lists = found.repartition("query_id", "place").sortWithinPartitions("query_id", "place")
    out = written(lists.mapInArrow(_heaps(k), "query_id bigint, rank int, vec_id bigint, score double"), "neighbours")
    work.drop()
    return out
