"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(col).isNotNull() & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def sizes(rows: DataFrame, col: str) -> list[int]:
    """The sizes of the usable vectors: vectors of different sizes never meet, and each size is treated in full."""
    return sorted(r.n for r in rows.filter(usable(col)).groupBy(F.size(col).alias("n")).count().collect())


def of_size(rows: DataFrame, col: str, dim: int) -> DataFrame:
    return rows.filter(usable(col) & (F.size(col) == dim))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as float64 rows."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)
