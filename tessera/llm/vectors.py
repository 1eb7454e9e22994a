"""What the two vector operators share: which vectors take part, and rows as blocks of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, with finite components only and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """A column of equally long vectors as a matrix of doubles."""
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def numbered(df: DataFrame, id_col: str, vec_col: str, *others: str) -> DataFrame:
    """vec_id, row (a number of its own for each stored row), v (null where the vector takes no part) and other columns."""
    v = F.col(f"`{vec_col}`")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.when(usable(v), v).alias("v"), *[F.col(f"`{o}`").alias(o) for o in others])
