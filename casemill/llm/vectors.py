"""Reading embedding columns: usable rows as packed doubles, and numpy views of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """True for vectors with at least one component, all finite, not all zero."""
    x = F.col(col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))


def numbered(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """rid (a number for each row; fixed once written), id, vec array<double>, ok, and further columns."""
    vec = F.col(vec_col).cast("array<double>")
    return df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), vec.alias("vec"), *more).withColumn("ok", usable("vec"))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal dimension as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.empty((0, 0))
