"""What the two vector operators share: which vectors take part, and random rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, dim: int) -> Column:
    """Neither null nor zero, of the common length, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The commonest length of a vector; the longer one of a tie, 1 if there is none."""
    found = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long lists as rows of length one."""
    x = matrix(column, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def rotations(n: int, dim: int, seed: int) -> np.ndarray:
    """n directions of unit length, orthogonal within each group of ``dim``."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(groups)[:n]
