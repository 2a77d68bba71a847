"""What the vector operators share: reading usable vectors and packing them into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """The vector is there and no component is null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length ``dim``, as a double matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
