"""What the vector operators of whole numbers share: usable rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this count as it, so that they and their differences fit 64 bits.
MOST = float(1 << 62)


def finite(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector is not null and holds only finite entries."""
    bad = F.exists(F.col(embedding).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(embedding).isNotNull() & ~bad)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of `width` doubles; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as 64-bit whole numbers; MOST and -MOST where it is beyond them. scale is a power of two."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)
