"""What the operators on embedding vectors share: which rows count, their whole numbers, and matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 1 << 28  # of a scaled entry: sums of squares then stay within 64 bits


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is neither null nor empty and has finite entries only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    v = F.col(f"`{vector_col}`")
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite))


def scaled(vector_col: str, scale: int = SCALE) -> Column:
    """Each entry as the long floor(scale * entry), computed in doubles."""
    return F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def width(vectors: DataFrame, vector_col: str) -> int:
    """The number of entries that all vectors have; 0 for an empty table.  Vectors of several lengths are an error."""
    size = F.size(F.col(f"`{vector_col}`"))
    least, most = vectors.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries: they need one length")
    return least or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of ``d`` entries a row as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def whole(column: pa.Array, d: int, scale: int = SCALE) -> np.ndarray:
    """The scaled whole numbers of a column of vectors; an entry of 2^28 or more after scaling is an error."""
    x = np.floor(matrix(column, d).astype(np.float64) * scale)
    if len(x) and max(x.max(), -x.min()) >= LARGEST:
        raise ValueError(f"an entry times {scale} reaches 2^28")
    return x.astype(np.int64)
