"""What the vector operators share: which vectors count, and Arrow columns of vectors as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, every component a finite number, not all zero.  Never null itself."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(vector, lambda v: v.isNotNull() & (v != 0))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & some, F.lit(False))


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix (double precision) of the vectors of each dimension."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def stacked(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)
