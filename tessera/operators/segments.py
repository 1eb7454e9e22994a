"""Log-structured tables: a base and the deltas after it, merged when they are read.

A segment holds rows and, in every delta, the keys whose earlier rows no longer count. A row lives if no later segment
names its key. Writing one changed note so costs that note's rows, and reading costs one join with the named keys;
after ``most`` deltas, or when they name too large a share of what lives, the merged rows become a new base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(parts: Sequence[tuple[DataFrame, DataFrame | None]], key: str, gone_key: str | None = None) -> DataFrame:
    """Living rows of (rows, named keys) segments, the base first; its named keys are ignored, and None names none.

    ``key`` is the rows' column and ``gone_key`` the named keys' (the same by default). Null keys are never named.
    """
    if not parts:
        raise ValueError("there is no segment")
    rows, gone = None, None
    for k, (part, named) in enumerate(parts):
        part = part.withColumn("_segment", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
        if k and named is not None:
            named = named.select(F.col(gone_key or key).alias("_named"), F.lit(k).alias("_by"))
            gone = named if gone is None else gone.unionByName(named)
    if gone is None:
        return rows.drop("_segment")
    last = gone.groupBy("_named").agg(F.max("_by").alias("_by"))  # one row a key, so the join keeps the number of rows
    return rows.join(last, (rows[key] == last["_named"]) & (F.col("_segment") < F.col("_by")), "left_anti").drop("_segment")


def due(deltas: int, named: int, living: int, most: int = 8, share: float = 0.35) -> bool:
    """Whether a store with so many deltas, that name so many of the living keys, is to be written as one base."""
    return deltas > most or named > share * max(living, 1)
