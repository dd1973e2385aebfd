"""Rows of embeddings as the vector operators read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector_col: str, **keep: Column) -> DataFrame:
    """The columns `keep`, and `vector` as doubles: rows whose vector is null or empty, or holds null or non-finite components, go."""
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(*(c.alias(k) for k, c in keep.items()), vector.alias("vector")).where((F.size("vector") > 0) & ~odd)


def integers(scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift of `vector`; beyond 2^31 it raises, as later sums couldn't be held."""

    def one(c: Column) -> Column:
        x = F.floor(c * scale)
        return F.when(F.abs(c) < float(2**31) / scale, x).otherwise(F.raise_error(F.lit(f"a component times {scale} doesn't fit 32 bits"))) + shift

    return F.transform("vector", one)


def dimension(rows: DataFrame, column: str) -> int:
    """The common length of the arrays in `column`, 0 without rows; different lengths raise."""
    low, high = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors differ in dimension: {low} and {high}")
    return low or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays, all of `width`, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(values: np.ndarray, terms: int, most: int) -> np.ndarray:
    """Integers as doubles, if `terms` products of numbers up to `most` are summed without rounding there, else as Python's integers."""
    return values.astype(np.float64) if terms * most * most < 2**53 else values.astype(object)
