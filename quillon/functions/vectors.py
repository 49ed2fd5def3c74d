"""Distances between the rows of a matrix and a vector, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column without nulls, one a row."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def squared_l2(rows: np.ndarray, query: Sequence[float]) -> np.ndarray:
    apart = rows - np.asarray(query, float)
    return np.einsum("ij,ij->i", apart, apart)


def dot_distance(rows: np.ndarray, query: Sequence[float]) -> np.ndarray:
    """The negative dot product: smaller is more alike."""
    return -(rows @ np.asarray(query, float))


def cosine_distance(rows: np.ndarray, query: Sequence[float]) -> np.ndarray:
    """One minus the cosine; 0 if either vector is zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * float(np.sqrt(np.square(np.asarray(query, float)).sum()))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 0, 1 - rows @ np.asarray(query, float) / norm, 0.0)


def finite(vector: Column) -> Column:
    """Whether all components are; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
