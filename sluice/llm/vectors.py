"""Reading vectors: rows that take part in similarity operators, as double-precision arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and has neither null nor non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | list, width: int | None = None) -> np.ndarray:
    """An Arrow list column, or a list of arrays, as a matrix of doubles."""
    if isinstance(column, list):
        return np.array(column, np.float64).reshape(len(column), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, width or 0))


def doubles(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    return df.where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
