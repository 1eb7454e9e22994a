"""Near-duplicate vectors of one label, by a subspace pigeonhole join.

Two unit vectors with cosine ``t`` lie at a squared distance of ``2 - 2t``. After a random rotation the components
are cut into blocks; if a pair is near, then in at least one block it lies within that block's share of the squared
distance, in proportion to its dimensions. So each block is range-joined on its own: vectors go to grid cells over
the block's first components and visit the cells within reach, and those that share a cell are compared by their
whole block. The union of all blocks' candidates is then verified on the original vectors in double precision.

Equal vectors of a label are one node with a count, so copies make no pairs. Cells are split into pieces of at most
``CELL_ROWS`` rows a side, so that no cell is one task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
link with nothing and are their own components; so are vectors of different lengths to each other; a null vec_id takes
part, and a component's id is its least vec_id that is not null; repeated rows are rows of their own; an empty table
gives an empty table. Other columns are ignored. Rows are numbered as they are read, so input that is not a plain read
of stored data is stored first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ODD, Scratch, mix, pick, stored
from tessera.llm.components import components
from tessera.llm.vectors import matrix, numbered

BLOCK_DIMS = 8
GRID_DIMS = 3
#: Cell sides, in reaches.
SIDE = 3.0
CELL_ROWS = 4096
#: Added to squared distances before comparing: far above rounding in single precision, far below a budget.
SLACK = 1e-5


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


_PLACED = "cell long, home boolean, node long, dims int, part binary"


def _place(threshold: float):
    """Each vector's cells: its home in every block, and the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            node, label, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2)
            sizes = np.array([len(v) for v in vectors.to_pylist()], np.int64) if len(node) else np.zeros(0, np.int64)
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                x = matrix(vectors.take(pa.array(own)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turn.setdefault(dims, rotation(dims))
                x = x @ turn[dims]
                tag = mix(label[own].view(np.uint64) * ODD + np.uint64(dims))
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
                for k, (a, b) in enumerate(blocks(dims)):
                    part = x[:, a:b].astype(np.float32)
                    reach = np.sqrt((2 - 2 * threshold) * (b - a) / dims + SLACK)
                    grid = part[:, :GRID_DIMS].astype(np.float64) / (SIDE * reach)
                    home = np.floor(grid).astype(np.int64)
                    steps = np.array(np.meshgrid(*[[-1, 0, 1]] * grid.shape[1])).reshape(grid.shape[1], -1).T
                    body = [r.tobytes() for r in part]
                    for step in steps:
                        there = home + step
                        # the part of the cell nearest to the vector lies within reach in every grid dimension
                        near = np.where(step < 0, grid - home, np.where(step > 0, home + 1 - grid, 0)) <= 1 / SIDE + 1e-6
                        chosen = np.flatnonzero(near.all(1))
                        cell = tag + np.uint64(k)
                        for g in range(grid.shape[1]):
                            cell = mix(cell * ODD + there[:, g].view(np.uint64))
                        at_home = not step.any()
                        out.append((cell[chosen].view(np.int64), np.full(len(chosen), at_home), node[own][chosen], [body[i] for i in chosen]))
                cells, home, nodes = (np.concatenate([o[i] for o in out]) for i in range(3))
                body = [x for o in out for x in o[3]]
                for at in range(0, len(cells), 50_000):
                    s = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[s]), pa.array(home[s]), pa.array(nodes[s]), pa.array(np.full(len(cells[s]), dims, np.int32)), pa.array(body[s], pa.binary())], names=["cell", "home", "node", "dims", "part"])

    return run


def _near(threshold: float):
    """Pairs of a piece of a cell that lie within the block's share of the squared distance."""

    def run(homes: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(homes) and len(visits):
            for (dims, size), own in homes.groupby([homes["dims"], homes["part"].str.len()]):
                others = visits[visits["part"].str.len() == size]
                if not len(others):
                    continue
                x = np.frombuffer(b"".join(own["part"]), np.float32).reshape(len(own), -1).astype(np.float64)
                y = np.frombuffer(b"".join(others["part"]), np.float32).reshape(len(others), -1).astype(np.float64)
                a, b = own["node"].to_numpy(), others["node"].to_numpy()
                yy = (y**2).sum(1)
                budget = (2 - 2 * threshold) * x.shape[1] / dims + SLACK
                for at in range(0, len(x), 512):
                    some = x[at : at + 512]
                    d = (some**2).sum(1)[:, None] + yy - 2 * some @ y.T
                    i, j = np.nonzero((d <= budget) & (a[at : at + 512][:, None] < b))
                    found.append((a[at + i], b[j]))
        a, b = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                x, y = (matrix(batch.column(c).take(pa.array(own))) for c in (2, 3))
                keep[own] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def link_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id and kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    own = stored(pick(df, id_col, vec_col, label_col), scratch).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    rows = numbered(own, "id", "vector", "label")
    linked = F.col("v").isNotNull() & F.col("label").isNotNull()
    digest = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    # rows that link with nothing have keys of their own, so that they are not dealt to one task as nulls
    digest = F.when(linked, digest).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    rows = rows.withColumn("alone", ~linked).withColumn("digest", digest).withColumn("label", F.col("label").cast("long"))
    nodes = rows.where(~F.col("alone")).groupBy("label", "digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.min("vec_id").alias("least"))
    nodes = scratch.save(nodes, "nodes")
    placed = scratch.save(nodes.select("node", "label", "v").mapInArrow(_place(threshold), _PLACED), "placed")
    pieces = F.ceil(F.col("rows") / CELL_ROWS).cast("int")
    counts = placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("rows"), F.count(F.lit(1)).alias("all"))
    counts = counts.where("rows > 0 and all > 1").select("cell", pieces.alias("home_pieces"), F.ceil(F.col("all") / CELL_ROWS).cast("int").alias("visit_pieces"))
    dealt = placed.join(counts, "cell")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    again = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  columns of their own for each side
    homes = dealt.where("home").select(*again("cell", "node", "dims", "part"), spot("home_pieces").alias("h"), F.explode(F.sequence(F.lit(0), F.col("visit_pieces") - 1)).alias("w"))
    visits = dealt.select(*again("cell", "node", "part"), F.explode(F.sequence(F.lit(0), F.col("home_pieces") - 1)).alias("h"), spot("visit_pieces").alias("w"))
    key = ["cell", "h", "w"]
    pairs = homes.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(_near(threshold), "a long, b long").distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"), F.col("v").alias(f"v_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("l_a") == F.col("l_b")) & (F.size("v_a") == F.size("v_b")))
    links = scratch.save(both.select("a", "b", "v_a", "v_b").mapInArrow(_exact(threshold), "a long, b long"), "links")
    up = components(links, scratch)
    counted = nodes.select("node", "copies")
    each = links.join(counted.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "copies").unionByName(links.join(counted.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "copies"))
    each = each.groupBy("node").agg(F.sum("copies").alias("others"))
    rooted = nodes.join(up.select(F.col("a").alias("node"), F.col("b").alias("up")), "node", "left").withColumn("root", F.coalesce("up", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").join(each, "node", "left").select("label", "digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("alone"), F.col("vec_id")).otherwise(F.coalesce("label", F.lit(0))).alias("label"), "digest", "alone").join(known, ["label", "digest"], "left")
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
