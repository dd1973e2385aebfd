"""Whitening of embeddings from an exact integer scatter.

A component c becomes the integer x = floor(scale * c) + offset. The fit list holds each distinct x vector
once. A task subtracts a shift (one of the fitted vectors) from its vectors and accumulates their sum S and
cross-products X'X in integers of any size: blocks of rows are multiplied in doubles while all sums stay
below 2^53, where doubles are exact, and in Python's integers otherwise. Tasks pass on these numbers in limbs
of 40 bits, summed by Spark as longs (exact for up to 2^23 tasks), and the driver puts d * (d + 3) / 2
integers together, d the dimension. n * X'X - SS' is formed from them exactly, whatever the shift; only then
are the entries, divided by n^2, rounded to doubles and decomposed by eigh.

Each kept row, repeated ones too, is then centred, projected and scaled where it stands; the components, a
matrix of d times `components` doubles, go along with the task. A last aggregate over the fit list measures
the whitened covariance.

Defined results: rows whose vector is null or empty, or holds null or non-finite components, go. Null and
repeated identifiers get their rows. Components whose eigenvalue isn't above `tolerance` times the largest
have no direction of their own within double precision and aren't returned: a table whose vectors are all
equal, like an empty one, gives no rows. Equal eigenvalues keep the order of the decomposition. Vectors of
different length and components beyond 2^31 / scale raise. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import Scratch
from quillon.llm._vectors import dimension, exact, integers, matrix, usable

LIMB = 40
BLOCK = 4096
RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _scatter(shift: np.ndarray):
    """Of the rows of a task: number (i = j = -1), sums (j = -1) and cross-products (i <= j) of x - shift, in signed limbs."""
    dims = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                y = matrix(batch.column(0).slice(lo, BLOCK), dims) - shift
                y = exact(y, len(y), int(np.abs(y).max()))
                n, sums = n + len(y), sums + _ints(y.sum(0))
                cross = cross + _ints(y.T.dot(y))
        if not n:
            return
        i, j = np.triu_indices(dims)
        found = [(-1, -1, n), *((k, -1, v) for k, v in enumerate(sums)), *zip(i.tolist(), j.tolist(), cross[i, j], strict=True)]
        limbs = [(a, b, k, limb) for a, b, v in found for k, limb in enumerate(_limbs(int(v)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*limbs, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "limb", "value"])

    return run


def _ints(v: np.ndarray) -> np.ndarray:
    return v if v.dtype == object else v.astype(np.int64).astype(object)


def _limbs(v: int) -> Iterator[int]:
    """v = sum of limb k times 2^(40 k), all of v's sign."""
    sign, v = (-1, -v) if v < 0 else (1, v)
    while True:
        yield sign * (v & ((1 << LIMB) - 1))
        v >>= LIMB
        if not v:
            return


def scatter(fit: DataFrame, column: str, shift: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * X'X - SS' of the integer vectors less `shift`, exactly."""
    dims = len(shift)
    parts = fit.select(column).mapInArrow(_scatter(np.array(shift, np.int64)), "i int, j int, limb int, value bigint").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    got: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # d * (d + 3) / 2 + 1 integers of a few limbs
        got[r.i, r.j] = got.get((r.i, r.j), 0) + (r.value << (LIMB * r.limb))
    n, sums = got[-1, -1], [got[i, -1] for i in range(dims)]
    return n, sums, [[n * got[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]


def _whiten(shift: np.ndarray, n: int, sums: list[int], axes: np.ndarray):
    """Rows (vec_id, ints) with deviation, the sum of (n * x - S)^2, and the coordinates on the scaled axes."""
    mean, total = np.array([s / n for s in sums]), np.array(sums, object)
    most = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column(1), len(shift)) - shift
                gap = n * int(np.abs(y).max()) + most
                apart = n * y - total.astype(np.int64) if len(shift) * gap * gap < 2**63 else n * y.astype(object) - total
                deviation = pa.array((apart * apart).sum(1).tolist(), pa.decimal128(38, 0)) if apart.dtype == object else pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
                whitened = (y - mean) @ axes
                yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(np.arange(0, whitened.size + 1, axes.shape[1], dtype=np.int32), whitened.ravel())], names=["vec_id", "deviation", "whitened"])

    return run


def _moments(shift: np.ndarray, n: int, sums: list[int], axes: np.ndarray):
    """Sums (j = -1) and cross-products of the whitened rows of a task."""
    mean, k = np.array([s / n for s in sums]), axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = (matrix(batch.column(0), len(shift)) - shift - mean) @ axes
            total, cross = total + z.sum(0), cross + z.T @ z
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(k), i], pa.int32()), pa.array(np.r_[np.full(k, -1), j], pa.int32()), pa.array(np.r_[total, cross[i, j]])], names=["i", "j", "value"])

    return run


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000, tolerance: float = 1e-9) -> DataFrame:
    """RESULT: a row for each kept row and component."""
    spark = vectors.sparkSession
    rows = usable(vectors, vector_col, vec_id=F.col(id_col).cast("bigint")).select("vec_id", integers(scale, offset).alias("x"))
    work = Scratch(spark, "whitening")
    fit = work.written(rows.select("x").distinct(), "fit")
    dims, found = dimension(fit, "x"), fit.first()
    if found is None:
        return spark.createDataFrame([], RESULT)
    shift = np.array(found.x, np.int64)
    n, sums, spread = scatter(fit, "x", found.x)
    covariance = np.array([[v / (n * n) for v in row] for row in spread])  # Python rounds the quotient of two integers once
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values > tolerance * max(values[0], 0)).sum()) if dims and values[0] > 0 else 0
    k = min(components, kept)
    if not k:
        return spark.createDataFrame([], RESULT)
    trace = sum(spread[i][i] for i in range(dims)) / (n * n)
    scaled = axes[:, :k] / np.sqrt(values[:k])
    moments = {(r.i, r.j): r.value / n for r in fit.select("x").mapInArrow(_moments(shift, n, sums, scaled), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}  # k * (k + 3) / 2 numbers
    off = max(abs(moments[i, j] - moments[i, -1] * moments[j, -1] - (i == j)) for i in range(k) for j in range(i, k))
    work.drop()
    out = rows.mapInArrow(_whiten(shift, n, sums, scaled), "vec_id bigint, deviation decimal(38,0), whitened array<double>")
    share = F.array(*(F.lit(float(v / trace)) for v in values[:k]))
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(off)).alias("identity_error"))
