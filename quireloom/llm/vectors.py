"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_whole(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """(rows, width) array of a list column; shorter vectors are filled up with zeros."""
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[-1], b.shape[-1])
    fill = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[-1]))) if x.shape[-1] < width else x
    return fill(a), fill(b)
