"""Connected components of a link table, by alternating star contractions.

Large-star and small-star rounds (Kiveris et al., 2014) link every record to the least one it reaches; the number of
rounds grows with the logarithm of the longest chain. A first pass contracts the links of each partition in memory,
block by block. Nothing but round totals reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

_LINKS = "a long, b long"
#: Links that are contracted in memory at a time.
BLOCK_LINKS = 2_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, least record of its component) of the records that are linked to a lesser one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        a = np.concatenate([x.column(0).to_numpy() for x in some])
        b = np.concatenate([x.column(1).to_numpy() for x in some])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in union_find(a, b)], names=["a", "b"])

    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.num_rows
        if size >= BLOCK_LINKS:
            yield block(some)
            some, size = [], 0
    if some:
        yield block(some)


def components(links: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(a, b): every record that is linked to a lesser one, and the least record of its component.

    ``links`` has columns a and b, ids in any order; repeated links and links of a record with itself are harmless.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = scratch.save(edges.mapInArrow(_contract, _LINKS), f"{label}-0")
    k, before = 0, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours go to the least one
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a record's lesser neighbours, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        new = scratch.save(small, f"{label}-{k}")
        total = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{label}-{k - 1}")
        now = new
        if (total["n"], total["h"]) == before:
            return now
        before = (total["n"], total["h"])
