"""Approximate nearest neighbours over balanced posting lists (after SPANN, Chen et al., 2021).

Centroids are fitted by balanced k-means on at most ``SAMPLE`` vectors; every vector is indexed. A vector joins the
lists of its nearest centroid and, near a boundary, of up to ``COPIES`` centroids whose distance is within
``1 + CLOSURE`` of the least, unless a chosen centroid lies nearer to that centroid than the vector does. Centroids
are found by best-first search over an in-memory neighbour graph of at most ``MOST_LISTS`` centroids, the only thing
that is sent to all tasks. A query reads the lists whose centroid lies within a ratio of its least distance. The ratio
is fitted on the sample: it reaches a list of ``TARGET`` of the true neighbours of ``PROBED`` sample vectors among
the sample. If the lists read hold fewer than ``LEAST`` vectors, further lists are read in order of distance, to the last one if need be,
so that a query gets ``k`` neighbours wherever there are so many. Lists are read in rounds, each some times the lists
before it: a list of a later round returns no vector that is farther than the ``k`` nearest found so far, so that what
a query's lists return hardly grows with their number.

Lists are cut into pieces of at most ``PIECE_ROWS`` vectors, so that neither a common vector nor a dense region is one
task. Distances are computed on the original vectors in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or
candidates; nor do vectors whose length is not the most frequent one (ties: the shorter); a query's own row is no
candidate, but a repeated row of the same vec_id is; equal distances are ordered by vec_id, then by place; null
vec_ids are candidates only and come first in ties; an empty table gives an empty table. Other columns are ignored.
Rows are numbered when they are first read, and stored with their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pick
from tessera.llm.vectors import matrix, numbered

SAMPLE = 20_000
LIST_ROWS = 256
MOST_LISTS = 4096
COPIES = 8
CLOSURE = 0.1
TARGET = 0.99
PROBED = 256
LEAST = 100
PIECE_ROWS = 4096
QUERY_ROWS = 1024
DEGREE = 24
#: Lists that a query's search asks for at first.
FIRST_LISTS = 32
#: Rounds of reading: a query's nearest so many lists, then up to so many; later ones return only what is near enough.
ROUNDS = (16, 256)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of about equally many vectors: crowded ones are charged a growing distance."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    charge = np.zeros(k)
    for _ in range(rounds):
        owner = np.concatenate([(distances(x[i : i + 2048], c) ** 2 + charge).argmin(1) for i in range(0, len(x), 2048)])
        count = np.bincount(owner, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, owner, x)
        full = count > 0
        c[full] = total[full] / count[full][:, None]
        spread = np.mean((x - c[owner]) ** 2) * x.shape[1]
        charge += 0.1 * spread * (count / (len(x) / k) - 1)
        for empty in np.flatnonzero(~full):
            c[empty] = x[rng.integers(len(x))]
    return c


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids with their neighbours and entry points; at most ``MOST_LISTS`` of them."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        k = len(centroids)
        d = distances(centroids, centroids)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, max(k - 1, 1))] if k > 1 else np.zeros((1, 1), np.int64)
        # a ring over all centroids keeps the graph connected
        ring = np.stack([(np.arange(k) + 1) % k, (np.arange(k) - 1) % k], 1)
        entries = np.linspace(0, k - 1, min(k, 16)).astype(np.int64)
        return cls(centroids, np.concatenate([near, ring], 1), np.unique(entries))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the ``width`` nearest centroids found and their distances, nearest first (unfilled: -1, inf)."""
        width = min(width, len(self.centroids))
        n = len(x)
        width_all = max(width, len(self.entries))
        ids = np.full((n, width_all), -1, np.int64)
        dist = np.full((n, width_all), np.inf)
        ids[:, : len(self.entries)] = self.entries
        dist[:, : len(self.entries)] = distances(x, self.centroids[self.entries])
        done = ids < 0
        norms = (self.centroids**2).sum(1)
        own = (x**2).sum(1)
        active = np.arange(n)
        while len(active):
            open_dist = np.where(done[active], np.inf, dist[active])
            best = open_dist.argmin(1)
            going = np.isfinite(open_dist[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            to = self.neighbours[ids[active, best]]
            d = np.sqrt(np.maximum(own[active][:, None] + norms[to] - 2 * np.einsum("ij,ikj->ik", x[active], self.centroids[to]), 0))
            all_ids = np.concatenate([ids[active], to], 1)
            all_dist = np.concatenate([dist[active], d], 1)
            all_done = np.concatenate([done[active], np.zeros_like(to, bool)], 1)
            order = np.argsort(all_ids, axis=1, kind="stable")
            ranked = np.take_along_axis(all_ids, order, 1)
            again = np.zeros_like(order, bool)
            np.put_along_axis(again, order[:, 1:], (ranked[:, 1:] == ranked[:, :-1]), 1)
            all_dist[again] = np.inf
            all_done[again] = True
            keep = np.argsort(all_dist, axis=1, kind="stable")[:, :width_all]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            dist[active] = np.take_along_axis(all_dist, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def lists_of(graph: CentroidGraph, apart: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest centroids, and which of them it joins."""
    ids, dist = graph.search(x, 2 * COPIES)
    joined = np.zeros(ids.shape, bool)
    joined[:, 0] = True
    for j in range(1, ids.shape[1]):
        ok = (ids[:, j] >= 0) & (dist[:, j] <= (1 + CLOSURE) * dist[:, 0]) & (joined.sum(1) < COPIES)
        for i in range(j):
            ok &= ~joined[:, i] | (apart[ids[:, j], ids[:, i]] >= dist[:, j])
        joined[:, j] = ok
    return ids, joined


def fit_ratio(graph: CentroidGraph, x: np.ndarray, k: int, seed: int = 5) -> float:
    """The distance ratio within which ``TARGET`` of the true neighbours of some sample vectors have a list."""
    if len(x) < 2 or len(graph.centroids) < 2:
        return 1.0
    chosen = np.random.default_rng(seed).choice(len(x), min(PROBED, len(x)), replace=False)
    apart = distances(graph.centroids, graph.centroids)
    parts = [lists_of(graph, apart, x[i : i + 2048]) for i in range(0, len(x), 2048)]
    ids, joined = (np.concatenate(p) for p in zip(*parts))
    need = []
    for q in chosen.tolist():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[:k]
        near = near[np.isfinite(d[near])]
        to = distances(x[q : q + 1], graph.centroids)[0]
        reach = np.where(joined[near], to[ids[near]], np.inf).min(1)
        need.append(reach / max(to.min(), 1e-12))
    return float(np.quantile(np.concatenate(need), TARGET))


def _assign(graph: CentroidGraph):
    """(list, first, known, vec_id, row, v) for each list that a vector joins; ``first`` marks its nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = distances(graph.centroids, graph.centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, joined = lists_of(graph, apart, matrix(part.column(3)))
                r, j = np.nonzero(joined)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, j].astype(np.int32)), pa.array(j == 0), *[part.column(c).take(take) for c in range(4)]], names=["list", "first", "known", "vec_id", "row", "v"])

    return run


def _probe(graph: CentroidGraph, held: np.ndarray, ratio: float):
    """(list, round, query_id, query_row, q) for each list that a query reads; ``held`` counts the vectors at home in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = matrix(part.column(3))
                todo, width = np.arange(len(x)), FIRST_LISTS
                while len(todo):  # the search widens until it has passed the ratio and has met enough vectors
                    ids, dist = graph.search(x[todo], width)
                    reached = np.cumsum(np.where(ids >= 0, held[ids], 0), 1)
                    before = np.concatenate([np.zeros((len(todo), 1), np.int64), reached[:, :-1]], 1)
                    read = (ids >= 0) & ((dist <= ratio * dist[:, :1] + 1e-12) | (before < LEAST))
                    ready = ~read[:, -1] | (width >= len(graph.centroids))
                    r, j = np.nonzero(read & ready[:, None])
                    take = pa.array(todo[r])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r, j].astype(np.int32)), pa.array(np.searchsorted(ROUNDS, j, side="right").astype(np.int32)), *[part.column(c).take(take) for c in (1, 2, 3)]], names=["list", "round", "query_id", "query_row", "q"])
                    todo, width = todo[~ready], width * 4

    return run


def _scan(k: int):
    """The nearest ``k`` of a piece of a list for each of its queries, none farther than the query's bound."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        which, chosen, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(queries) and len(rows):
            y, row = matrix(rows["v"]), rows["row"].to_numpy()
            known, ids = rows["known"].to_numpy(), rows["vec_id"].to_numpy()
            x, own, bound = matrix(queries["q"]), queries["query_row"].to_numpy(), queries["bound"].to_numpy()
            last = min(k, len(y) - 1)
            for at in range(0, len(x), 256):
                # one product ranks the piece; what may be among the nearest is measured again, exactly
                near = (x[at : at + 256] ** 2).sum(1)[:, None] + (y**2).sum(1) - 2 * x[at : at + 256] @ y.T
                near[own[at : at + 256][:, None] == row] = np.inf
                slack = 1e-9 * (1 + (x[at : at + 256] ** 2).sum(1) + (y**2).sum(1).max())
                q, c = np.nonzero(near <= (np.minimum(np.partition(near, last, axis=1)[:, last], bound[at : at + 256] ** 2) + slack)[:, None])
                mine = own[at + q] != row[c]
                q, c = q[mine] + at, c[mine]
                d = np.concatenate([np.sqrt(((x[q[i : i + 8192]] - y[c[i : i + 8192]]) ** 2).sum(1)) for i in range(0, len(q), 8192)] or [np.zeros(0)])
                within = d <= bound[q]
                q, c, d = q[within], c[within], d[within]
                order = np.lexsort((row[c], ids[c], known[c], d, q))
                q, c, d = q[order], c[order], d[order]
                first = np.searchsorted(q, q)  # each query's best k
                few = np.arange(len(q)) - first < k
                which.append(q[few])
                chosen.append(c[few])
                score.append(d[few])
        q, c = np.concatenate(which), np.concatenate(chosen)
        parts = [("query_id", queries, q), ("query_row", queries, q), ("known", rows, c), ("vec_id", rows, c), ("row", rows, c)]
        return pd.DataFrame({name: df[name].to_numpy()[at] for name, df, at in parts} | {"score": np.concatenate(score)})

    return run


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest rows found of each row whose id ``every`` divides."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lists")
    rows = scratch.save(numbered(pick(df, id_col, vec_col), id_col, vec_col).where("v is not null"), "rows").withColumn("dims", F.size("v"))
    sizes = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}  # one row per length
    dims = min((d for d in sizes if sizes[d] == max(sizes.values())), default=1)
    rows, total = rows.where(F.col("dims") == dims), sizes.get(dims, 0)
    lists = min(MOST_LISTS, max(1, total // LIST_ROWS))
    spot = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(spot < SAMPLE / max(total, 1)).select("v").toPandas() if total else pd.DataFrame({"v": []})
    x = matrix(sample["v"]) if len(sample) else np.zeros((1, dims))
    graph = CentroidGraph.build(balanced_kmeans(x, min(lists, len(x))))
    numbers = rows.select(F.col("vec_id").isNotNull().alias("known"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "row", "v")
    posted = scratch.save(numbers.mapInArrow(_assign(graph), rows_schema(df, vec_col)), "posted")
    count = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("home"))
    held = np.zeros(len(graph.centroids), np.int64)
    for r in count.collect():  # at most MOST_LISTS rows
        held[r["list"]] = r["home"]
    queries = numbers.where(F.col("known") & (F.col("vec_id") % every == 0))
    probes = scratch.save(queries.mapInArrow(_probe(graph, held, fit_ratio(graph, x, k)), f"list int, round int, query_id long, query_row long, q {df.schema[vec_col].dataType.simpleString()}"), "probes")
    pieces = count.select("list", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"))
    best = None
    for turn in range((probes.agg(F.max("round")).first()[0] or 0) + 1):
        best = scratch.save(_read(posted, probes.where(F.col("round") == turn), pieces, best, k), f"best{turn}")
    return best.select("query_id", "rank", F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), "score")


def _read(posted: DataFrame, probes: DataFrame, pieces: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """The best ``k`` of each query after one more round of lists."""
    if best is None:
        probes = probes.withColumn("bound", F.lit(float("inf")))
    else:
        bounds = best.where(F.col("rank") == k).select("query_row", F.col("score").alias("bound"))
        probes = probes.join(bounds, "query_row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asked = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("groups"))
    plan = pieces.join(asked, "list")
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = probes.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"), cell("query_row", "groups").alias("g"), "query_id", "query_row", "q", "bound")
    right = posted.join(plan, "list").select("list", cell("row", "pieces").alias("p"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "known", "vec_id", "row", "v")
    key = ["list", "p", "g"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_scan(k), "query_id long, query_row long, known boolean, vec_id long, row long, score double")
    if best is not None:
        found = found.unionByName(best.drop("rank"))
    w = Window.partitionBy("query_row").orderBy("score", "known", "vec_id", "row")
    return found.dropDuplicates(["query_row", "row"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rows_schema(df: DataFrame, vec_col: str) -> str:
    return f"list int, first boolean, known boolean, vec_id long, row long, v {df.schema[vec_col].dataType.simpleString()}"
