"""Vector columns as numpy matrices, and which vectors are usable."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of numbers, all of one length."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
