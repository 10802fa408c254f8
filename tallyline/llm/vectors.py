"""Vectors as double-precision rows with a validity test, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str | Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def bounded_sample(vectors: DataFrame, n: int, total: int, column: str = "vector") -> np.ndarray:
    """The ``n`` distinct rows of least hash, as a matrix; rows of a length other than the first row's are left out.

    Only hashes under a bound that lets about ``8 * n`` of the ``total`` rows pass are
    ordered, so what partitions send stays small however many there are.
    """
    marked = vectors.select(column, F.xxhash64(column).alias("mark"))
    low = -(1 << 63)
    bound = low + int((1 << 64) * min(1.0, 8 * n / max(1, total)))
    rows = []
    for few in ([marked.where(F.col("mark") < F.lit(bound))] if bound < (1 << 63) else []) + [marked]:
        rows = [r[0] for r in few.distinct().orderBy("mark").limit(n).select(column).collect()]
        if len(rows) >= n:
            break
    rows = [r for r in rows if len(r) == len(rows[0])]
    return np.array(rows, float)
