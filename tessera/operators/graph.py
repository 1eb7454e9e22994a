"""Weighted document graphs: edges, communities, hubs, affinities and legends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text

T = TypeVar("T")

# fixed values: weights of features and edges
FEATURE_WEIGHTS = {"title": 1.5, "aliases": 1.8, "tags": 4.2, "headings": 1.6}
LINK_WEIGHT, NAVIGATION_PENALTY, RING_WEIGHT, RING_NEIGHBOURS = 0.65, 0.08, 5.0, 3
SEMANTIC_WEIGHT, SEMANTIC_NEIGHBOURS, SEMANTIC_FLOOR = 1.4, 10, 0.08
STRENGTH, STEPS, ANCHOR = 0.52, 4, 0.72
#: Edges of a graph that one task may cluster; larger ones are contracted by Louvain levels that distribute.
LOUVAIN_EDGES = 1_000_000
#: Ends of edges in a block whose moves one task weighs; a node's own stay together.
BLOCK_ENDS = 400_000
#: Nodes of a graph whose communities each task may hold as arrays (some 20 bytes a node); more are told by joins.
HELD_NODES = 1_000_000
#: Rows that one task groups or joins, where a step deals them itself: adaptive execution goes by packed bytes.
PART_ROWS = 500_000
#: Features (rows of id and term) in a block of ids whose pairs one task weighs.
BLOCK_FEATURES = 100_000


def parts(spark: SparkSession, rows: int) -> int:
    """How many parts to deal so many rows into."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def merge_edges(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Undirected edges (src < dst, w): weights add up; loops and weights that are not positive and finite go.

    With ``parts`` edges are dealt into so many, else as the session does.
    """
    ok = (F.col("src") != F.col("dst")) & (F.col("w") > 0) & ~F.isnan("w") & (F.col("w") < float("inf"))
    rows = edges.where(ok).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return (rows.repartition(parts, "src", "dst") if parts else rows).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def reweight(edges: DataFrame, weight: Column) -> DataFrame:
    return edges.withColumn("w", weight).where("w > 0")


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) by weight."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))


def ring_edges(members: DataFrame, weight: float = RING_WEIGHT, neighbours: int = RING_NEIGHBOURS) -> DataFrame:
    """Each member (grp, node) with its next ones in a ring by id; the weight falls with the root of the distance."""
    w = Window.partitionBy("grp")
    placed = members.withColumn("pos", F.row_number().over(w.orderBy("node")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    asked = placed.withColumn("off", F.explode(F.sequence(F.lit(1), F.least(F.lit(neighbours), F.col("n") - 1).cast("int")))).select("grp", F.col("node").alias("x"), ((F.col("pos") + F.col("off")) % F.col("n")).alias("pos"), "off")
    pairs = asked.join(placed.select("grp", "pos", F.col("node").alias("y")), ["grp", "pos"])
    # in small rings a pair is met from both sides; the first meeting counts
    once = pairs.groupBy("grp", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.min_by("off", F.struct(F.col("x"), F.col("off"))).alias("off"))
    return once.select("src", "dst", (F.lit(weight) / F.sqrt("off")).alias("w"))


def path_counts(docs: DataFrame, path: str = "path") -> DataFrame:
    """(prefix, depth, documents): documents under each folder."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    prefixes = F.transform(F.when(F.size(folders) > 0, F.sequence(F.lit(1), F.size(folders))), lambda d: F.struct(F.array_join(F.slice(folders, F.lit(1), d), "/").alias("prefix"), d.alias("depth")))
    return docs.select(F.explode(prefixes).alias("p")).groupBy("p.prefix", "p.depth").agg(F.count(F.lit(1)).alias("documents"))


def projects(docs: DataFrame, generic: Sequence[str] = (), most: int = 1200) -> DataFrame:
    """(id, project): the shallowest folder with 2 to ``most`` documents and a telling name, else the deepest with 2, else the first."""
    counts = path_counts(docs)
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    own = docs.select("id", F.explode_outer(F.transform(F.when(F.size(folders) > 0, F.sequence(F.lit(1), F.size(folders))), lambda d: F.array_join(F.slice(folders, F.lit(1), d), "/"))).alias("prefix"))
    seen = own.join(counts, "prefix", "left")
    telling = ~F.lower(text.humanize(F.element_at(F.split("prefix", "/"), -1))).isin(list(generic)) if generic else F.lit(True)
    good = (F.col("documents") >= 2) & telling
    picked = seen.groupBy("id").agg(
        F.min_by("prefix", F.when(good & (F.col("documents") <= most), F.col("depth"))).alias("a"),
        F.max_by("prefix", F.when(good, F.col("depth"))).alias("b"), F.min_by("prefix", "depth").alias("c"),
        F.min(F.when(good & (F.col("documents") <= most), F.col("depth"))).alias("has_a"), F.max(F.when(good, F.col("depth"))).alias("has_b"),
    )
    chosen = F.when(F.col("has_a").isNotNull(), F.col("a")).when(F.col("has_b").isNotNull(), F.col("b")).otherwise(F.col("c"))
    return picked.select("id", F.coalesce(chosen, F.concat(F.lit("@root:"), F.col("id").cast("string"))).alias("project"))


def marker_features(assigned: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """(id, term, w) of what is known of documents: contexts, topics, the parent theme, and priority words they hold.

    ``assigned`` has id, contexts and topics (arrays), parent (null: none) and searchable, a normalized text.
    """
    listed = lambda c, head, w: F.transform(F.col(c), lambda x: F.struct(F.concat(F.lit(head), x).alias("term"), w(x).alias("w")))
    found = F.filter(F.array(*[F.lit(p.lower()) for p in priority]).cast("array<string>"), lambda p: F.contains(F.col("searchable"), p))
    parent = F.when(F.col("parent").isNotNull(), F.array(F.struct(F.col("parent").alias("term"), F.lit(2.4).alias("w")))).otherwise(F.array().cast("array<struct<term:string,w:double>>"))
    rows = F.concat(
        listed("contexts", "@context:", lambda x: F.lit(4.5)), listed("topics", "@topic:", lambda x: F.when(x == "product-management", 2.2).otherwise(5.2)), parent,
        F.transform(found, lambda p: F.struct(F.concat(F.lit("@priority:"), p).alias("term"), F.lit(4.0).alias("w"))),
    )
    return assigned.select("id", F.inline(rows)).groupBy("id", "term").agg(F.max("w").alias("w"))


def features(docs: DataFrame, generic: list[str] | None = None, markers: DataFrame | None = None) -> DataFrame:
    """(id, term, w): graph terms of title, aliases, tags, headings and folders; the greatest weight of a term counts.

    ``markers`` are further rows, from :func:`marker_features`.
    """
    kinds = dict(docs.dtypes)
    parts = []
    for name, w in FEATURE_WEIGHTS.items():
        if name in kinds:
            value = F.explode(name) if kinds[name].startswith("array") else F.col(name)
            parts.append(docs.select("id", value.alias("v"), F.lit(w).alias("w")))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    at = docs.select("id", F.posexplode(folders).alias("i", "v"), F.size(folders).alias("n"))
    parts.append(at.select("id", text.humanize(F.col("v")).alias("v"), F.when(F.col("i") == F.col("n") - 1, 0.55).otherwise(0.2).alias("w")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = rows.select("id", F.explode(text.graph_tokens(F.col("v"), generic)).alias("term"), "w")
    found = found if markers is None else found.unionByName(markers.select("id", "term", "w"))
    return found.groupBy("id", "term").agg(F.max("w").alias("w"))


def semantic_edges(feats: DataFrame, weight: float = SEMANTIC_WEIGHT, k: int = SEMANTIC_NEIGHBOURS, floor: float = SEMANTIC_FLOOR, faithful: bool = True) -> DataFrame:
    """(src, dst, similarity, w): TF-IDF neighbours, each node's best ``k``, either end may choose.

    Terms in over max(24, 16 %) of the documents make no pairs; a posting of over 48 documents meets only the next 8
    of each in id order. In the ``faithful`` form postings of up to 48 count every pair twice, and longer ones meet
    around the ring once.

    Rows are dealt into blocks by ranges of ids. As neighbours in a posting are near in id order, a block weighs its ids'
    pairs itself, given a few rows of the blocks after it.
    """
    n, rows = feats.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)), F.sum("c")).first()
    blocks = max(1, -(-(rows or 0) // BLOCK_FEATURES))
    df = feats.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    weighted = feats.join(df, "term").select("id", "term", "df", (F.col("w") * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)).alias("v"))
    ranged = weighted.repartitionByRange(blocks, "id").withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))).withColumn("block", F.spark_partition_id())
    usable = ranged.where((F.col("df") <= max(24, round(n * 0.16))) | F.col("term").startswith("@priority:"))
    small, large = usable.where("df <= 48"), usable.where("df > 48")
    x, y = (small.select("term", *[F.col(c).alias(s + c) for c in ("id", "v", "norm", "block")]) for s in "ab")
    dots = x.join(y, "term").where("aid < bid").select(F.col("ablock").alias("at"), F.col("aid").alias("a"), F.col("bid").alias("b"), (F.col("av") * F.col("bv") * (2.0 if faithful else 1.0)).alias("d"), F.col("anorm").alias("na"), F.col("bnorm").alias("nb"))
    # a row goes to its own block and to those of the rows before it that meet it, so that no pair is sent
    order = Window.partitionBy("term").orderBy("id")
    ring = large.select("term", "id", "v", "norm", "block").withColumn("pos", F.row_number().over(order) - 1).withColumn("ats", F.array_distinct(F.array_compact(F.array("block", *[F.lag("block", k).over(order) for k in range(1, 9)]))))
    dealt = ring.select(F.explode("ats").alias("at"), "block", "term", "pos", "id", "v", "norm").repartition(blocks, "at")
    ahead = F.collect_list(F.struct("id", "v", "norm")).over(Window.partitionBy("at", "term").orderBy("pos").rowsBetween(1, 8))
    met = dealt.withColumn("ahead", ahead).where(F.col("block") == F.col("at")).select("at", "id", "v", "norm", F.explode("ahead").alias("o"))
    met = met.select("at", F.col("id").alias("a"), F.col("o.id").alias("b"), (F.col("v") * F.col("o.v")).alias("d"), F.col("norm").alias("na"), F.col("o.norm").alias("nb"))
    # where a ring closes, its last rows meet the first ones
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = ring.withColumn("left", F.count(F.lit(1)).over(whole) - F.col("pos")).withColumn("heads", F.array(*[F.nth_value(F.struct("id", "v", "norm", "block"), k).over(whole) for k in range(1, 9)]))
    closing = ring.where("left <= 8").select("id", "v", "norm", F.explode(F.slice("heads", F.lit(1), (9 - F.col("left")).cast("int"))).alias("o"))
    closing = closing.select(F.col("o.block").alias("at"), F.col("o.id").alias("a"), F.col("id").alias("b"), (F.col("o.v") * F.col("v")).alias("d"), F.col("o.norm").alias("na"), F.col("norm").alias("nb"))
    others = dots.unionByName(closing).repartition(blocks, "at")
    scored = met.unionByName(others).groupBy("at", "a", "b", "na", "nb").agg(F.sum("d").alias("d"))
    scored = scored.select("a", "b", (F.col("d") / (F.col("na") * F.col("nb"))).alias("similarity")).where(F.col("similarity") >= floor)
    ends = scored.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "similarity")
    best = ends.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "b", "a"))).where(F.col("r") <= k)
    return best.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("similarity").alias("similarity")).withColumn("w", F.col("similarity") * weight)


def hybrid_edges(links: DataFrame, navigation: DataFrame, members: DataFrame, feats: DataFrame) -> DataFrame:
    """Links (weakened at navigation notes), group rings and semantic edges as one graph. ``navigation`` has node."""
    nav = navigation.select(F.col("node"), F.lit(True).alias("_nav"))
    l1 = links.join(nav.select(F.col("node").alias("src"), F.col("_nav").alias("_s")), "src", "left").join(nav.select(F.col("node").alias("dst"), F.col("_nav").alias("_d")), "dst", "left")
    weight = F.col("w") * LINK_WEIGHT * F.when(F.col("_s") | F.col("_d"), NAVIGATION_PENALTY).otherwise(1.0)
    return merge_edges(l1.select("src", "dst", weight.alias("w")).unionByName(ring_edges(members)).unionByName(semantic_edges(feats).select("src", "dst", "w")))


def _order(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def louvain(src: Sequence, dst: Sequence, w: Sequence[float], resolution: float = 1.0, passes: int = 20, levels: int = 10, seed: int = 17) -> dict:
    """Communities of a graph in memory by local moves and aggregation (Blondel et al., 2008); deterministic."""
    names, at = np.unique(np.concatenate([np.asarray(src), np.asarray(dst)]), return_inverse=True)
    a, b, weight = at[: len(src)], at[len(src) :], np.asarray(w, float)
    owner = np.arange(len(names))
    for level in range(levels):
        n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1 if len(a) else 0
        if not n:
            break
        near: list[dict[int, float]] = [{} for _ in range(n)]
        degree = np.zeros(n)
        for x, y, v in zip(a.tolist(), b.tolist(), weight.tolist()):
            degree[x] += v
            degree[y] += v
            if x != y:
                near[x][y] = near[x].get(y, 0.0) + v
                near[y][x] = near[y].get(x, 0.0) + v
        total, home, held = degree.sum(), list(range(n)), degree.copy()
        moved = False
        for p in range(passes):
            changed = False
            for x in _order(n, seed + 1009 * level + p).tolist():
                here, k = home[x], degree[x]
                if k <= 0:
                    continue
                held[here] -= k
                gains: dict[int, float] = {here: 0.0}
                for y, v in near[x].items():
                    gains[home[y]] = gains.get(home[y], 0.0) + v
                best, most = here, 0.0
                for c in sorted(gains):
                    g = gains[c] - resolution * held[c] * k / total
                    if g > most + 1e-12 or (abs(g - most) <= 1e-12 and g > 0 and c < best):
                        best, most = c, g
                held[best] += k
                home[x] = best
                changed |= best != here
            moved |= changed
            if not changed:
                break
        if not moved:
            break
        kept = {c: i for i, c in enumerate(dict.fromkeys(home))}
        new = np.array([kept[c] for c in home])
        owner = new[owner]
        a, b = new[a], new[b]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pair, inv = np.unique(lo * (len(kept) + 1) + hi, return_inverse=True)
        weight = np.bincount(inv.ravel(), weights=weight)
        a, b = pair // (len(kept) + 1), pair % (len(kept) + 1)
        if len(kept) <= 1:
            break
    rank = {c: i for i, c in enumerate(dict.fromkeys(owner.tolist()))}
    return {x: rank[c] for x, c in zip(names.tolist(), owner.tolist())}


def communities(edges: DataFrame, part: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(node, community) by Louvain within each value of ``part`` (a connected part; the whole graph if none).

    A part of at most ``LOUVAIN_EDGES`` edges is clustered in one task. A larger one, one at a time, is contracted by
    :func:`spread_level` until it is that small or no move gains, then refined: nodes move once more between the
    communities found, on the whole graph. Communities are numbered from 0 within a part.
    """
    grouped = edges if part else edges.withColumn("_part", F.lit(0))
    key = part or "_part"
    kind = dict(edges.dtypes)["src"]
    sizes = grouped.groupBy(key).count()
    large = [r[0] for r in sizes.where(F.col("count") > LOUVAIN_EDGES).select(key).collect()]  # each stands for many edges

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        got = louvain(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["w"].tolist(), resolution)
        return pd.DataFrame({"node": list(got), "community": list(got.values()), "part": [str(pdf[key].iloc[0])] * len(got)})

    in_memory = lambda df: df.select(key, "src", "dst", "w").groupBy(key).applyInPandas(run, f"node {kind}, community int, part string")
    rest = grouped
    if large:
        own_checkpoint_dir(edges.sparkSession)
        for value in large:
            rest = rest.where(~F.col(key).eqNullSafe(F.lit(value)))  # a join would send all edges
    out = in_memory(rest)
    for value in large:
        own = grouped.where(F.col(key).eqNullSafe(F.lit(value)))
        out = out.unionByName(_contracted(own.select("src", "dst", "w"), resolution, lambda df, value=value: in_memory(df.withColumn(key, F.lit(value)))).withColumn("part", F.lit(str(value))))
    return out if part else out.drop("part")


def _contracted(edges: DataFrame, resolution: float, in_memory: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, community) of one graph with too many edges for a task."""
    packed = _Packed.of(edges)
    if packed is not None:
        return _contracted_in_arrays(packed, resolution)
    owner, level = None, 0
    whole = now = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w")).checkpoint()
    while now.count() > LOUVAIN_EDGES:  # a level that moves nothing ends it; any other leaves fewer nodes
        label = spread_level(now, level, resolution)
        if label is None:
            break
        level += 1
        step = label.select(F.col("node").alias("_owner"), F.col("community").alias("_next"))
        owner = (label if owner is None else owner.join(step, F.col("community") == F.col("_owner")).select("node", F.col("_next").alias("community"))).checkpoint()
        now = induced(now, label).checkpoint()
    if now.count() <= LOUVAIN_EDGES:
        final = in_memory(now).select(F.col("node").alias("_owner"), F.col("community").alias("_final"))
    else:  # no move gains any more: number what there is
        ends = both_ways(now).select(F.col("src").alias("_owner")).distinct()
        final = _numbered(ends, "_owner").select("_owner", F.col("n").cast("int").alias("_final"))
    if owner is None:
        return final.select(F.col("_owner").alias("node"), F.col("_final").alias("community"))
    placed = owner.join(final, F.col("community") == F.col("_owner")).select("node", F.col("_final").alias("community")).checkpoint()
    refined = spread_level(whole, level, resolution, passes=8, start=placed)
    if refined is None:
        return placed
    place = _numbered(refined.select("community").distinct(), "community").withColumnRenamed("n", "_n")  # some may have lost all their nodes
    return refined.join(place, "community").select("node", F.col("_n").cast("int").alias("community"))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, n) with n from 0 in the order of a key without repeats, by counts per range of a stored copy."""
    ranged = df.repartitionByRange(key).withColumn("_r", F.spark_partition_id()).checkpoint()
    before = F.sum("c").over(Window.orderBy("_r")) - F.col("c")  # one row per range
    offset = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("c")).select("_r", before.alias("o"))
    return ranged.join(F.broadcast(offset), "_r").select(key, (F.col("o") + F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1).alias("n"))


def spread_level(edges: DataFrame, level: int = 0, resolution: float = 1.0, passes: int = 20, start: DataFrame | None = None) -> DataFrame | None:
    """(node, community) after one Louvain level of moves in parallel; null if none gains.

    Communities bear a node's name, or those of ``start`` (node, community), from which the moves then set out.

    In each pass a coin of every community says whether its nodes may leave or others may join, so no two swap. Nodes
    that join together may be too many: a pass that lowers the modularity is undone, and fewer nodes move in the next.
    Passes end when five were undone, or when in five together nothing moved or the modularity rose by less than 1e-4.

    Edges are dealt into blocks by node once and stay there; a pass sends each block the labels that its edges meet, and
    weighs its nodes' moves in arrays. What a pass leads to is judged by the next one, which adds up the inner weight.
    """
    both = both_ways(edges)
    blocks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-2 * edges.count() // BLOCK_ENDS))
    block = F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int")
    near = both.where("src <> dst").withColumn("block", block).repartition(blocks, "block").sortWithinPartitions("block").checkpoint()
    degree = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).checkpoint()
    total = degree.agg(F.sum("k")).first()[0]
    loops = edges.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
    met = near.select(F.col("block").alias("at"), F.col("dst").alias("node")).distinct().withColumn("own", F.lit(False))
    met = met.unionByName(degree.select("node", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("at"), F.lit(True).alias("own"))).checkpoint()
    kind = dict(degree.dtypes)["node"]

    def run(ends: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _moves(ends, told, resolution, total)

    def step(label: DataFrame, p: int, failed: int) -> tuple[DataFrame, float, bool]:
        """Where nodes go in pass ``p``, the modularity before it, and whether any goes."""
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(level), F.lit(p)), F.lit(2))
        held = label.groupBy("community").agg(F.sum("k").alias("held")).withColumn("open", coin("community") == 0)
        free = ~F.col("open") & (F.pmod(F.xxhash64("node", F.lit(p), F.lit(level)), F.lit(1 << failed)) == 0)
        told = met.join(label.join(held, "community").withColumn("free", free), "node")
        new = near.groupBy("block").cogroup(told.groupBy("at")).applyInPandas(run, f"node {kind}, community {kind}, k double, v double, shifts boolean").checkpoint()
        inner, any_shift = new.agg(F.sum("v"), F.bool_or("shifts")).first()
        apart = held.agg(F.sum(F.col("held") * F.col("held"))).first()[0]
        return new.select("node", "community", "k"), ((inner or 0.0) + 2 * loops) / total - resolution * apart / total**2, bool(any_shift)

    label = degree.select("node", F.col("node").alias("community"), "k") if start is None else degree.join(start, "node").select("node", F.col("community").cast(kind).alias("community"), "k").checkpoint()
    label = _passes(step, label, passes)
    if label is None:
        return None
    return label.select("node", "community") if start is None else label.select("node", F.col("community").cast(dict(start.dtypes)["community"]).alias("community"))


def _passes(step: Callable[[T, int, int], tuple[T, float, bool]], label: T, passes: int) -> T | None:
    """The labels that passes of moves end with, see :func:`spread_level`; null if none stayed.

    ``step`` (labels, pass, how many were undone) returns where nodes go, the modularity before it, and whether any goes.
    """
    moved, failed, idle, p = False, 0, 0, 0
    new, now, shifts = step(label, 0, 0)
    while True:
        if not shifts:
            idle += 1
        else:
            ahead, q, shifts_then = step(new, p + 1, 0)  # judges this pass and, if it stays, is the next
            if q > now + 1e-12:
                idle = idle + 1 if q < now + 1e-4 else 0
                label, now, moved, failed = new, q, True, 0
                new, shifts, p = ahead, shifts_then, p + 1
                if idle == 5 or p == passes:
                    break
                continue
            failed += 1
        p += 1
        if idle == 5 or failed == 5 or p == passes:
            break
        new, _, shifts = step(label, p, failed)
    return label if moved else None


def _moves(ends: pd.DataFrame, told: pd.DataFrame, resolution: float, total: float) -> pd.DataFrame:
    """Of a block's own nodes: the community each goes to, its degree, its weight within the one it leaves, if it shifts.

    ``ends`` are the block's edges by src; ``told`` has what the pass knows of their ends (a node's community, its
    degree and whether it is free, the community's degrees and whether it is open), once more for own nodes.
    """
    own = told[told["own"]].reset_index(drop=True)
    names, rank = np.unique(told["community"].to_numpy(), return_inverse=True)
    held, open_ = np.zeros(len(names)), np.zeros(len(names), bool)
    held[rank], open_[rank] = told["held"].to_numpy(), told["open"].to_numpy()
    home, k, n, c = np.searchsorted(names, own["community"].to_numpy()), own["k"].to_numpy(), len(own), len(names)
    other = ~told["own"].to_numpy()
    to = rank[other][pd.Index(told["node"][other]).get_indexer(ends["dst"])] if len(ends) else np.zeros(0, np.int64)
    at = pd.Index(own["node"]).get_indexer(ends["src"])
    # a vote of 0 for each own community, so that staying is weighed, too
    pair = np.concatenate([at.astype(np.int64) * c + to, np.arange(n, dtype=np.int64) * c + home])
    pairs, where = np.unique(pair, return_inverse=True)
    v = np.bincount(where.ravel(), weights=np.concatenate([ends["w"].to_numpy(), np.zeros(n)]), minlength=len(pairs))
    x, y = pairs // c, pairs % c
    stays = y == home[x]
    g = v - resolution * (held[y] - np.where(stays, k[x], 0.0)) * k[x] / total
    stay, inner = np.zeros(n), np.zeros(n)
    stay[x[stays]], inner[x[stays]] = g[stays], v[stays]
    joins = ~stays & open_[y] & own["free"].to_numpy()[x]
    x, y, g = x[joins], y[joins], g[joins]
    order = np.lexsort((y, -g, x))
    first, at_first = np.unique(x[order], return_index=True)
    best = order[at_first]
    shifts = np.zeros(n, bool)
    shifts[first] = g[best] > stay[first] + 1e-12
    goes = home.copy()
    goes[first] = np.where(shifts[first], y[best], home[first])
    return pd.DataFrame({"node": own["node"], "community": names[goes], "k": k, "v": inner, "shifts": shifts})


class _Packed:
    """A graph of at most ``HELD_NODES`` nodes, numbered by name, as stored rows of arrays, one for each block of nodes.

    A block has all ends of edges of its nodes, so a pass reads the blocks where they are, with every node's community
    at hand, and returns its nodes' communities: nothing is shuffled.
    """

    @classmethod
    def of(cls, edges: DataFrame) -> _Packed | None:
        """The graph, or null if it has more nodes than tasks may hold. Edges are read twice."""
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "w", (F.col("src") == F.col("dst")).alias("loop"))
        degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("ends"), F.sum("w").alias("k"), (F.sum(F.when(F.col("loop"), F.col("w"))) / 2).alias("loops")).checkpoint()
        return cls(edges, degree) if degree.count() <= HELD_NODES else None

    def __init__(self, edges: DataFrame, degree: DataFrame):
        nodes = degree.toPandas().sort_values("node", ignore_index=True)
        self.context, self.nodes, self.kind = edges.sparkSession.sparkContext, degree.select("node"), dict(degree.dtypes)["node"]
        self.n, self.k, self.loops = len(nodes), nodes["k"].to_numpy(), nodes["loops"].fillna(0.0).to_numpy()
        most = min(BLOCK_ENDS, -(-int(nodes["ends"].sum()) // self.context.defaultParallelism))
        at = ((nodes["ends"].cumsum() - nodes["ends"]) // most).to_numpy()
        self.names, self.degrees = self.context.broadcast(nodes["node"].to_numpy()), self.context.broadcast(self.k)
        names, first = self.names, self.context.broadcast(at)
        blocks = max(self.context.defaultParallelism, len(np.unique(at)))

        def deal(pdfs: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            index, held, rows = pd.Index(names.value), [], 0
            for pdf in pdfs:
                held.append((index.get_indexer(pdf["src"]), index.get_indexer(pdf["dst"]), pdf["w"].to_numpy(float)))
                rows += len(pdf)
                if rows >= BLOCK_ENDS:
                    yield _dealt(held, first.value)
                    held, rows = [], 0
            if held:
                yield _dealt(held, first.value)

        dealt = edges.select("src", "dst", "w").mapInPandas(deal, "block long, x binary, y binary, w binary").repartition(blocks, "block")
        n = self.n

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, w = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("x", np.int32), ("y", np.int32), ("w", float)))
            pairs, where = np.unique(x.astype(np.int64) * n + y, return_inverse=True)
            w = np.bincount(where.ravel(), weights=w)
            return pd.DataFrame({"x": [(pairs // n).astype(np.int32).tobytes()], "y": [(pairs % n).astype(np.int32).tobytes()], "w": [w.tobytes()]})

        self.rows = dealt.groupBy("block").applyInPandas(join, "x binary, y binary, w binary").checkpoint()

    def spread(self, level: int, resolution: float, passes: int = 20, start: np.ndarray | None = None) -> np.ndarray | None:
        """The community of each node, as :func:`spread_level` finds it, numbered from 0 without gaps; null if no move gains."""
        n, k, loops, total, degrees = self.n, self.k, float(self.loops.sum()), float(self.k.sum()), self.degrees

        def step(label: np.ndarray, p: int, failed: int) -> tuple[np.ndarray, float, bool]:
            held = np.bincount(label, weights=k)
            open_ = np.random.default_rng([level, p]).random(len(held)) < 0.5
            free = ~open_[label] & (np.random.default_rng([level, p, failed]).integers(0, 1 << failed, n) == 0)
            told = self.context.broadcast((label.astype(np.int32), held, open_, free))

            def run(pdfs: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
                for pdf in pdfs:
                    for row in pdf.itertuples(index=False):
                        yield _moves_in_arrays(*_arrays(row), *told.value, degrees.value, resolution, total)

            got = sorted(self.rows.mapInPandas(run, "own binary, goes binary, v double, shifts boolean").collect())
            told.destroy()
            new = label.copy()
            for r in got:
                new[np.frombuffer(r["own"], np.int32)] = np.frombuffer(r["goes"], np.int32)
            q = (sum(r["v"] for r in got) + 2 * loops) / total - resolution * float(held @ held) / total**2
            return np.unique(new, return_inverse=True)[1].ravel(), q, any(r["shifts"] for r in got)

        return _passes(step, np.arange(n) if start is None else np.unique(start, return_inverse=True)[1].ravel(), passes)

    def induced(self, label: np.ndarray) -> DataFrame:
        """(src, dst, w) between communities, once or more; inner weight stays as loops."""
        told = self.context.broadcast(label)

        def run(pdfs: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for pdf in pdfs:
                for row in pdf.itertuples(index=False):
                    x, y, w = _arrays(row)
                    once = x < y
                    a, b = told.value[x[once]], told.value[y[once]]
                    ties = pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "w": w[once]})
                    yield ties.groupby(["src", "dst"], as_index=False)["w"].sum()

        loops = np.bincount(label, weights=self.loops)
        own = [(int(c), int(c), float(loops[c])) for c in np.flatnonzero(loops)]
        return self.rows.mapInPandas(run, "src long, dst long, w double").unionByName(self.nodes.sparkSession.createDataFrame(own, "src long, dst long, w double"))

    def frame(self, label: np.ndarray) -> DataFrame:
        """(node, community), stored."""
        names, told = self.names, self.context.broadcast(label)

        def run(pdfs: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            index = pd.Index(names.value)
            for pdf in pdfs:
                yield pd.DataFrame({"node": pdf["node"], "community": told.value[index.get_indexer(pdf["node"])]})

        return self.nodes.mapInPandas(run, f"node {self.kind}, community int").checkpoint()


def _dealt(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: np.ndarray) -> pd.DataFrame:
    """Edges between numbered nodes as arrays of ends for each block; ``first`` has each node's block."""
    a, b, w = (np.concatenate(c) for c in zip(*held))
    apart = a != b
    a, b, w = a[apart], b[apart], w[apart]
    x, y, w = np.concatenate([a, b]).astype(np.int32), np.concatenate([b, a]).astype(np.int32), np.concatenate([w, w])
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    block, at = np.unique(first[x], return_index=True)
    cut = lambda v: [c.tobytes() for c in np.split(v, at[1:])][: len(block)]
    return pd.DataFrame({"block": block, "x": cut(x), "y": cut(y), "w": cut(w)})


def _arrays(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.x, np.int32), np.frombuffer(row.y, np.int32), np.frombuffer(row.w, float)


def _moves_in_arrays(x: np.ndarray, y: np.ndarray, w: np.ndarray, label: np.ndarray, held: np.ndarray, open_: np.ndarray, free: np.ndarray, k: np.ndarray, resolution: float, total: float) -> pd.DataFrame:
    """One row for a block with ends ``x`` to ``y`` (x in order): its nodes, where they go, their inner weight, if any shifts.

    Only ends of free nodes in open communities are sorted, as the others bear on no choice.
    """
    new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    own, at, to = x[new], np.cumsum(new) - 1, label[y]
    home, k, inside = label[own], k[own], to == label[x]
    inner = np.bincount(at[inside], weights=w[inside], minlength=len(own))
    goes, shifts = home.copy(), False
    met = free[x] & open_[to]
    if met.any():
        pair = at[met] * np.int64(len(held)) + to[met]
        order = np.argsort(pair)
        pair, v = pair[order], w[met][order]
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        v, i, c = np.add.reduceat(v, start), pair[start] // len(held), pair[start] % len(held)
        g = v - resolution * held[c] * k[i] / total
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        best = np.maximum.reduceat(g, start)
        first = np.minimum.reduceat(np.where(g == np.repeat(best, np.diff(np.r_[start, len(g)])), np.arange(len(g)), len(g)), start)
        i, c = i[first], c[first]
        gains = best > inner[i] - resolution * (held[home[i]] - k[i]) * k[i] / total + 1e-12
        goes[i[gains]], shifts = c[gains], bool(gains.any())
    return pd.DataFrame({"own": [own.tobytes()], "goes": [goes.astype(np.int32).tobytes()], "v": [float(inner.sum())], "shifts": [shifts]})


def _contracted_in_arrays(packed: _Packed, resolution: float) -> DataFrame:
    """(node, community) of a graph in blocks, by the steps of :func:`_contracted`."""
    owner, level, now, rest = np.arange(packed.n), 0, packed, None
    while True:
        label = now.spread(level, resolution)
        if label is None:  # no move gains any more
            break
        level += 1
        owner = label[owner]
        rest = now.induced(label).groupBy("src", "dst").agg(F.sum("w").alias("w")).checkpoint()
        if rest.count() <= LOUVAIN_EDGES:
            owner = _louvain_in_task(rest, resolution)[owner]
            break
        now = _Packed.of(rest)
    refined = packed.spread(level, resolution, 8, owner) if level else None
    return packed.frame(np.unique(owner if refined is None else refined, return_inverse=True)[1].ravel())


def _louvain_in_task(edges: DataFrame, resolution: float) -> np.ndarray:
    """The community of each node of 0, 1, ... by :func:`louvain`; the number of edges was checked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        got = louvain(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["w"].tolist(), resolution)
        return pd.DataFrame({"node": list(got), "community": list(got.values())})

    got = edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node long, community int").toPandas()
    return got.sort_values("node")["community"].to_numpy()


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community) for graphs of any size: each node takes the heaviest label among its neighbours and itself."""
    spark = edges.sparkSession
    edges = stored(edges)
    deal = parts(spark, 2 * edges.count())
    both = both_ways(edges).repartition(deal, "dst")
    label = both.select(F.col("dst").alias("node")).distinct().withColumn("community", F.col("node")).checkpoint()
    for _ in range(rounds):
        told = both.join(label.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "community", "w")
        votes = told.repartition(deal, "node", "community").groupBy("node", "community").agg(F.sum("w").alias("v"))
        votes = votes.unionByName(label.withColumn("v", F.lit(1e-9)))
        label = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community")).checkpoint()
    return label


def stored(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, for what several jobs read."""
    own_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def own_checkpoint_dir(spark: SparkSession) -> None:
    import tempfile

    if not (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())


def induced(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(src, dst, w) between communities; inner weight stays as loops."""
    s = assigned.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    d = assigned.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    return edges.join(s, "src").join(d, "dst").groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w"))


def consolidate(edges: DataFrame, assigned: DataFrame, most: int = 12, least: int = 2, project: DataFrame | None = None) -> DataFrame:
    """(node, community): the ``most`` heaviest communities of ``least`` nodes or more; others join the kept one of their
    project, or the one they are tied to most, or -1.

    With ``project`` (node, project), one community is kept per dominant project.
    """
    deg = degrees(edges)
    sized = assigned.join(deg, "node").groupBy("community").agg(F.sum("degree").alias("score"), F.count(F.lit(1)).alias("n"))
    if project is not None:
        from tessera.operators.dedup import mode_value

        sized = sized.join(mode_value(assigned.join(project, "node"), "community", "project").select("community", "project"), "community", "left")
    else:
        sized = sized.withColumn("project", F.lit(None).cast("string"))
    best = Window.partitionBy(F.coalesce("project", F.concat(F.lit("\x00"), F.col("community").cast("string")))).orderBy(F.desc("score"), F.desc("n"), "community")
    top = sized.where(F.col("n") >= least).withColumn("_first", F.row_number().over(best)).where("_first = 1")
    kept = top.orderBy(F.desc("score"), F.desc("n"), "community").limit(most)
    kept = kept.withColumn("final", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n"), "community")) - 1).select("community", "final", F.col("project").alias("kept_project"))  # at most `most` rows
    ties = both_ways(induced(edges, assigned)).where("src <> dst").join(F.broadcast(kept.select(F.col("community").alias("dst"), "final")), "dst")
    tied = ties.groupBy(F.col("src").alias("community")).agg(F.min_by("final", F.struct(-F.col("w"), F.col("final"))).alias("tied"))
    by_project = kept.where("kept_project is not null").select(F.col("kept_project").alias("project"), F.col("final").alias("by_project"))
    placed = sized.select("community", "project").join(F.broadcast(kept.select("community", "final")), "community", "left").join(F.broadcast(by_project), "project", "left").join(tied, "community", "left")
    return assigned.join(placed.select("community", F.coalesce("final", "by_project", "tied", F.lit(-1)).alias("final")), "community", "left").select("node", F.coalesce("final", F.lit(-1)).cast("int").alias("community"))


#: Edges and items that one task settles, at most.
SETTLED = 1_000_000


def settled(todo: DataFrame, votes: DataFrame, near: DataFrame, rounds: int = 2) -> DataFrame:
    """(item, community) as if items chose one after the other, in the order of ``turn``; -1 where nothing speaks for one.

    An item joins the community that is tied to it most: by ``votes`` (item, community, w) that are there from the
    start, and by its ``near`` (item, other, w) items that chose before it. So it can choose once no earlier one near it
    is open, and all such items choose at once: each round settles one layer of this dependency. After ``rounds``, when
    what is left fits a task, that task goes on in order; the result is the same.
    """
    own_checkpoint_dir(todo.sparkSession)
    turn = todo.select(F.col("item").alias("other"), F.col("turn").alias("_then"))
    waits = near.groupBy("item", "other").agg(F.sum("w").alias("w")).join(todo.select("item", "turn"), "item").join(turn, "other")
    waits = waits.where(F.col("_then") < F.col("turn")).select("item", "other", "w").checkpoint()
    votes = votes.groupBy("item", "community").agg(F.sum("w").alias("w")).checkpoint()
    left, out, n = todo.select("item", "turn"), None, 0
    while True:
        best = votes.groupBy("item").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community"))
        ready = left.join(waits.select("item").distinct(), "item", "left_anti")
        done = ready.join(best, "item", "left").select("item", F.coalesce("community", F.lit(-1)).cast("int").alias("community")).checkpoint()
        out = done if out is None else out.unionByName(done)
        left = left.join(done.select("item"), "item", "left_anti").checkpoint()
        if left.isEmpty():
            return out
        chosen = done.select(F.col("item").alias("other"), "community")
        told = waits.join(chosen.where("community >= 0"), "other").select("item", "community", "w")
        votes = votes.join(left.select("item"), "item", "left_semi").unionByName(told).groupBy("item", "community").agg(F.sum("w").alias("w")).checkpoint()
        waits = waits.join(chosen.select("other"), "other", "left_anti").checkpoint()
        n += 1
        if n >= rounds and max(waits.count(), votes.count(), left.count()) <= SETTLED:
            return out.unionByName(_settled_in_task(left, votes, waits))


def _settled_in_task(left: DataFrame, votes: DataFrame, waits: DataFrame) -> DataFrame:
    """The rest of :func:`settled`, item by item; its size was checked."""
    placed = left.withColumn("at", F.row_number().over(Window.orderBy("turn")))
    at, other = placed.select("item", "at"), placed.select(F.col("item").alias("other"), F.col("at").alias("to"))
    rows = votes.join(at, "item").select("at", F.lit(None).cast("int").alias("to"), "community", "w")
    rows = rows.unionByName(waits.join(at, "item").join(other, "other").select("at", "to", F.lit(None).cast("int").alias("community"), "w"))
    rows = rows.unionByName(at.select("at", F.lit(None).cast("int").alias("to"), F.lit(None).cast("int").alias("community"), F.lit(0.0).alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["at"].max())
        tied: list[dict[int, float]] = [{} for _ in range(n + 1)]
        near: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, to, community, w in pdf[["at", "to", "community", "w"]].itertuples(index=False):
            if not pd.isna(community):
                tied[i][int(community)] = tied[i].get(int(community), 0.0) + w
            elif not pd.isna(to):
                near[int(to)].append((i, w))
        out = []
        for i in range(1, n + 1):
            best = min(tied[i], key=lambda c: (-tied[i][c], c), default=-1)
            out.append(best)
            for later, w in near[i] if best >= 0 else ():
                tied[later][best] = tied[later].get(best, 0.0) + w
        return pd.DataFrame({"at": range(1, n + 1), "community": out})

    got = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "at int, community int")
    return got.join(at, "at").select("item", "community")


def consolidate_projects(edges: DataFrame, nodes: DataFrame, most: int = 12, least: int = 2) -> DataFrame:
    """(node, community): communities are the largest projects; other nodes join the one they are tied to most, or -1.

    ``nodes`` has node, project (null: none) and weight. Projects of ``least`` nodes rank by weight, degree, size and
    name. Topic groups (``@topic:pm-``) come first, then up to max(3, 34 %) knowledge groups (``@knowledge:``), then the
    rest. Projects that are not kept join as wholes, one after the other in their rank; then single nodes do, in the
    order of their ids. Each sees where those before it went.

    Edges are read four times, so a caller whose edges are dear stores them.
    """
    grouped = nodes.where(F.col("project").isNotNull() & ~F.col("project").startswith("@root:"))
    exact = F.coalesce("weight", F.lit(1.0)).try_cast("decimal(28,12)")  # sums of doubles follow the order of rows and part equal ranks
    sized = grouped.join(degrees(edges), "node", "left").groupBy("project").agg(F.sum(exact).alias("eff"), F.sum(F.coalesce("degree", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"))
    order = [F.desc("eff"), F.desc("score"), F.desc("n"), F.col("project")]
    knowledge = F.col("project").startswith("@knowledge:")
    kind = F.when(F.col("project").rlike(r"^@topic:pm-(?:skills(?::[^:]+)?|prompts)$"), 0).when(knowledge, 1).otherwise(2)
    ranked = sized.where(F.col("n") >= least).withColumn("kind", kind)
    reserve = max(3, round(most * 0.34))
    ranked = stored(ranked.withColumn("in_kind", F.row_number().over(Window.partitionBy("kind").orderBy(*order))))
    turn = F.when(F.col("kind") == 0, 0).when((F.col("kind") == 1) & (F.col("in_kind") <= reserve), 1).otherwise(2)
    kept = ranked.withColumn("turn", turn).orderBy("turn", *order).limit(most)
    kept = kept.select("project", (F.row_number().over(Window.orderBy("turn", *order)) - 1).cast("int").alias("community"))  # at most `most` rows
    home = nodes.select("node", "project").join(F.broadcast(kept), "project", "left").checkpoint()

    def placed_ends(placed: DataFrame, c: str) -> DataFrame:
        """Edges with what ``placed`` has of their ends: ``c`` and ``other``."""
        near = edges.join(placed.select(F.col("node").alias("src"), F.col(c)), "src")
        return near.join(placed.select(F.col("node").alias("dst"), F.col(c).alias("other")), "dst")

    # projects as wholes
    open_ones = ranked.join(kept.select("project"), "project", "left_anti").select(F.col("project").alias("item"), F.struct(-F.col("eff"), -F.col("score"), -F.col("n"), "project").alias("turn")).checkpoint()
    ties = placed_ends(home, "project").where("project <> other").groupBy(F.col("project").alias("item"), "other").agg(F.sum("w").alias("w")).checkpoint()
    ends = ties.unionByName(ties.select(F.col("other").alias("item"), F.col("item").alias("other"), "w")).join(open_ones.select("item"), "item", "left_semi")
    to_kept = ends.join(F.broadcast(kept.withColumnRenamed("project", "other")), "other").select("item", "community", "w")
    between = ends.join(open_ones.select(F.col("item").alias("other")), "other", "left_semi").select("item", "other", "w")
    joined = settled(open_ones, to_kept, between)
    joined = joined.where("community >= 0").select(F.col("item").alias("project"), F.col("community").alias("joined"))
    placed = home.join(joined, "project", "left").select("node", F.coalesce("community", "joined").alias("community")).checkpoint()

    # single nodes
    alone = placed.where("community is null").select(F.col("node").alias("item"), F.col("node").alias("turn"))
    told = placed_ends(placed, "community").where("src <> dst")
    votes = told.where("community is null and other is not null").select(F.col("src").alias("item"), F.col("other").alias("community"), "w")
    votes = votes.unionByName(told.where("community is not null and other is null").select(F.col("dst").alias("item"), "community", "w"))
    near = told.where("community is null and other is null").select(F.col("src").alias("item"), F.col("dst").alias("other"), "w")
    late = settled(alone, votes, near.unionByName(near.select(F.col("other").alias("item"), F.col("item").alias("other"), "w")))
    late = late.select(F.col("item").alias("node"), F.col("community").alias("late"))
    return placed.join(late, "node", "left").select("node", F.coalesce("community", "late", F.lit(-1)).alias("community"))


def representative_scores(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, score): ``ln(1 + degree)``, raised by title terms, lowered for navigation and hidden notes.

    ``nodes`` has node, title, navigation (boolean) and display_weight.
    """
    terms = F.size(text.graph_tokens(F.col("title")))
    weight = F.least(F.greatest(F.coalesce("display_weight", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    seen = F.when(weight >= 0.2, 0.65 + 0.35 * weight).otherwise(0.025)
    scored = nodes.join(degrees(edges), "node", "left")
    score = F.log1p(F.coalesce("degree", F.lit(0.0))) * (1 + F.least(F.lit(0.45), 0.045 * terms)) * F.when(F.col("navigation"), 0.06).otherwise(1.0) * seen
    return scored.select("node", score.alias("score"))


def hubs(assigned: DataFrame, scores: DataFrame) -> DataFrame:
    """(community, hub): each community's node with the greatest score, ties by id."""
    return assigned.where("community >= 0").join(scores, "node").groupBy("community").agg(F.min_by("node", F.struct(-F.col("score"), F.col("node"))).alias("hub"))


def propagate(edges: DataFrame, assigned: DataFrame, hub: DataFrame, steps: int = STEPS, strength: float = STRENGTH, anchor: float = ANCHOR) -> DataFrame:
    """(node, community, a): affinities after some steps of ``(1 - s) * own + s * neighbours' mean``, hubs anchored."""
    both = both_ways(edges)
    mean = both.join(both.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))
    own = assigned.where("community >= 0").select("node", "community", F.lit(1.0).alias("a"))
    held = hub.select(F.col("hub").alias("node"), "community")
    normal = lambda df: df.withColumn("a", F.col("a") / F.sum("a").over(Window.partitionBy("node")))
    now = own
    for _ in range(steps):
        spread = mean.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "community", (strength * F.col("p") * F.col("a")).alias("a"))
        new = own.withColumn("a", F.col("a") * (1 - strength)).unionByName(spread).groupBy("node", "community").agg(F.sum("a").alias("a"))
        new = normal(new)
        now = normal(new.unionByName(held.withColumn("a", F.lit(anchor))).groupBy("node", "community").agg(F.sum("a").alias("a")))
    rest = now.join(held.select("node"), "node", "left_anti")
    return rest.unionByName(held.withColumn("a", F.lit(1.0)))


def blend_colors(affinity: DataFrame, colors: DataFrame) -> DataFrame:
    """(node, r, g, b): community colours (community, r, g, b) mixed in linear light by affinity."""
    from tessera.functions import numeric

    mixed = affinity.join(F.broadcast(colors), "community").groupBy("node").agg(*[(F.sum(F.col("a") * numeric.to_linear(F.col(c))) / F.sum("a")).alias(c) for c in "rgb"])
    return mixed.select("node", *[numeric.from_linear(F.col(c)).cast("int").alias(c) for c in "rgb"])


def colorize(edges: DataFrame, affinity: DataFrame, colors: DataFrame, nodes: DataFrame, neutral: str = "#8B92A1", fade: float = 0.18) -> DataFrame:
    """(node, color): a node's own colour if it has one, a hub's community colour, else its communities' mixed by
    affinity and faded to neutral, more so at the rim, where affinity is unsure, and for copies.

    ``nodes`` has node, color (null: none), hub (its community, null: not a hub) and display_weight.
    """
    from tessera.functions import numeric

    fixed = [int(neutral[i : i + 2], 16) for i in (1, 3, 5)]
    mixed = blend_colors(affinity, colors)
    sure = affinity.groupBy("node").agg((F.max("a") / F.sum("a")).alias("sure"))
    deg = degrees(edges)
    top = deg.agg(F.greatest(F.lit(1.0), F.max("degree")).alias("top"))
    own = colors.select(F.col("community").alias("hub"), *[F.col(c).alias(f"h{c}") for c in "rgb"])
    rows = nodes.join(mixed, "node", "left").join(sure, "node", "left").join(deg, "node", "left").join(F.broadcast(own), "hub", "left").crossJoin(F.broadcast(top))
    ratio = F.log1p(F.coalesce("degree", F.lit(0.0))) / F.log1p("top")
    dim = numeric.clamp(fade * (1 - ratio) * (0.65 + 0.35 * (1 - F.col("sure"))) + (1 - numeric.clamp(F.coalesce("display_weight", F.lit(1.0)), 0, 1)) * 0.06, 0, 0.72)
    part = lambda c, v: numeric.from_linear(numeric.to_linear(F.col(c)) * (1 - F.col("dim")) + numeric.to_linear(F.lit(v)) * F.col("dim"))
    faded = numeric.hex_color(*[part(c, v) for c, v in zip("rgb", fixed)])
    hub = numeric.hex_color(*[F.col(f"h{c}") for c in "rgb"])
    chosen = F.coalesce(F.lower("color"), F.when(F.col("r").isNotNull(), F.coalesce(F.when(F.col("hub").isNotNull(), hub), faded)), F.lit(neutral.lower()))
    return rows.withColumn("dim", dim).select("node", chosen.alias("color"))


def legend(docs: DataFrame) -> DataFrame:
    """(theme, topic, size, percentage): a roll-up of (theme, topic); topic is null for a theme's total."""
    total = docs.groupBy().agg(F.count(F.lit(1)).alias("total"))
    rolled = docs.rollup("theme", "topic").agg(F.count(F.lit(1)).alias("size"), F.grouping_id().alias("level")).where("level < 3")
    return rolled.crossJoin(F.broadcast(total)).select("theme", F.when(F.col("level") == 0, F.col("topic")).alias("topic"), "size", (100.0 * F.col("size") / F.col("total")).alias("percentage"))


def natural_break(shares: DataFrame) -> DataFrame:
    """The rows (key, size, percentage), largest first, before the greatest relative drop. One row per theme."""
    w = Window.orderBy(F.desc("size"), "key")
    ranked = shares.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("percentage").over(w))
    drop = (F.col("percentage") - F.col("next")) / F.greatest(F.col("percentage"), F.lit(2.220446049250313e-16))
    cut = ranked.where("next is not null").agg(F.min_by("rank", F.struct(-drop, F.col("rank"))).alias("cut"))
    return ranked.crossJoin(F.broadcast(cut)).where(F.col("rank") <= F.coalesce("cut", F.lit(1))).select("key", "size", "percentage", "rank")


def cluster_summary(assigned: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, size, visible, degree): ``nodes`` has node and display_weight; visible ones weigh 0.2 or more."""
    rows = assigned.join(nodes, "node", "left").join(degrees(edges), "node", "left")
    seen = F.coalesce("display_weight", F.lit(1.0)) >= 0.2
    return rows.where("community >= 0").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.sum(seen.cast("long")).alias("visible"), F.sum(F.coalesce("degree", F.lit(0.0))).alias("degree"))


def cluster_parents(assigned: DataFrame, parents: DataFrame, clusters: DataFrame) -> DataFrame:
    """(parent, size, visible, communities): clusters rolled up by the parent that over half of their nodes have.

    ``parents`` has node and parent (null: none); ``clusters`` is :func:`cluster_summary`'s. Clusters without such a
    parent are left out.
    """
    held = assigned.where("community >= 0").join(parents, "node", "left").groupBy("community", "parent").agg(F.count(F.lit(1)).alias("n"))
    whole = held.groupBy("community").agg(F.sum("n").alias("all"), F.max(F.struct("n", "parent")).alias("m"))
    own = whole.where((F.col("m.n") * 2 > F.col("all")) & F.col("m.parent").isNotNull()).select("community", "m.parent")
    rolled = clusters.join(own, "community").groupBy("parent")
    return rolled.agg(F.sum("size").alias("size"), F.sum("visible").alias("visible"), F.array_sort(F.collect_list("community")).alias("communities"))


def modularity(src: Iterable, dst: Iterable, w: Iterable[float], group: dict, resolution: float = 1.0) -> float:
    """Quality of a partition, for tests and reports on graphs in memory."""
    inner, degree, total = 0.0, {}, 0.0
    for x, y, v in zip(src, dst, w):
        total += v
        inner += v * (group[x] == group[y])
        for z in (x, y):
            degree[group[z]] = degree.get(group[z], 0.0) + v
    return inner / total - resolution * sum(d * d for d in degree.values()) / (4 * total * total)
