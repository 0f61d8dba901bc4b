"""What the vector operators share: which vectors take part, and packed matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that are there, have components, and hold only finite ones."""
    value = F.col(column)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(value.isNotNull() & (F.size(value) > 0) & finite, F.lit(False))


def doubles(column: str) -> Column:
    """The components as doubles, with one zero."""
    return F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0))


def matrix(lists: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Rows of equal length from a list column."""
    return np.asarray(lists.flatten()).astype(dtype, copy=False).reshape(len(lists), -1)


def unpacked(data: pa.Scalar, dtype: type) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype)
