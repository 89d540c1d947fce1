"""Vectors of whole numbers: the rows that take part, and their cells as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256

#: Doubles below this hold whole numbers exactly.
EXACT = 2.0**53
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def whole_vectors(table: DataFrame, vec_col: str, *more: Column) -> DataFrame:
    """(row, *more, v): v = floor(256 x) of every component, as doubles; ``row`` numbers the rows.

    Rows whose vector is null or holds a null, NaN or infinite component
    are left out. ``row`` is stable once the result is written.
    """
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(*more, F.col(vec_col).cast("array<double>").alias("v")).filter(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    # floor() gives a long; a double of 2^53 or more is a whole number already
    down = F.transform("v", lambda c: F.when(F.abs(c * SCALE) < EXACT, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return rows.withColumn("v", down).withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
        column.flatten().to_numpy(zero_copy_only=False)
    )
    return out


def nullable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of longs and where it is null (there 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def large_products(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows of any size, cut to the range of a long."""
    left = [int(x) for x in q]
    sums = (sum(a * int(b) for a, b in zip(left, row, strict=True)) for row in vectors)
    return np.array([max(LEAST, min(MOST, s)) for s in sums], dtype=np.int64)
