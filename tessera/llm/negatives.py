"""Hard negatives by a two-dimensional block matrix product.

Scores are inner products of whole numbers, ``floor(256 x)`` of each component. The product of anchors and rows is
computed by blocks (SUMMA): rows and anchors are dealt into blocks, vectors are cut into chunks of dimensions, and
each (anchor block, row block, chunk) is a task of its own that multiplies two small matrices. The partial tiles of the
chunks are shuffled to their (anchor block, row block), added as 64-bit integers, and reduced there to the few best of
each anchor. Nothing but these goes on.

There are two products. Rows are dealt by a hash of their label first, so the first one, for the positives, meets an
anchor with rows of its own hash only. Positives give each anchor its score windows; the second product meets it with
all rows and keeps, in each tile, the first negatives in each window.

Block numbers come from a row's stored number, so a label that holds most rows fills many blocks, and no block depends
on the order of a read. The counts of at most ``BUCKETS`` label hashes are all that reaches the driver.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; zero and empty
vectors do, and score 0; a shorter vector counts as if zeros followed. A null id is no anchor, and comes after all
others on ties; repeated rows are rows of their own, and an anchor excludes only its own row. Whole numbers too large
for 64-bit sums are added exactly and then bounded to 62 bits. An empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, expand, lean, pick, squeeze

#: Hashes of labels that positives are dealt by.
BUCKETS = 64
#: Rows and anchors that a block holds, about, and dimensions of a chunk.
BLOCK_ROWS, BLOCK_ANCHORS, CHUNK_DIMS = 2048, 512, 32
SCALE = 256.0
_MOST = 1 << 62
_LAST_ID = (1 << 63) - 1

_TILE = "g int, b int, d int, meta binary, m binary"


def _pack(chunk: int):
    """A block's vectors as one matrix for each chunk of dimensions; what else is known of its rows goes with the first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "row"])
        sizes = [len(v) for v in rows["v"]]
        m = np.zeros((len(rows), max(sizes, default=0)))
        for i, v in enumerate(rows["v"]):
            m[i, : sizes[i]] = v
        m = np.floor(SCALE * m)
        known = [rows["row"].to_numpy(np.int64), rows["order"].to_numpy(np.int64), rows["no_id"].to_numpy(bool), rows["label"].to_numpy(np.int64)]
        if "asked" in rows:
            known.append([[int(x["positive_score"]) for x in v] for v in rows["asked"]])
        out = [(int(rows["g"].iloc[0]), int(rows["b"].iloc[0]), d, squeeze(*known) if d == 0 else None, squeeze(m[:, d * chunk : (d + 1) * chunk])) for d in range(max(1, -(-m.shape[1] // chunk)))]
        return pd.DataFrame(out, columns=["g", "b", "d", "meta", "m"])

    return run


def _narrow(tile: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    most = max(abs(int(tile.max())), abs(int(tile.min()))) if tile.size else 0
    return tile.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of whole numbers held as doubles; 64-bit integers, bounded to 62 bits."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * n if a.size and b.size else 0.0
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


def added(tiles: list[np.ndarray]) -> np.ndarray:
    """The sum of partial tiles, bounded to 62 bits."""
    if sum(float(np.abs(t.astype(np.float64)).max()) if t.size else 0.0 for t in tiles) < float(_MOST):
        return np.sum([t.astype(np.int64) for t in tiles], axis=0)
    return np.clip(sum(t.astype(object) for t in tiles), -_MOST, _MOST).astype(np.int64)


def _multiply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        tile = known = None  # one side has no such dimensions, which count as zeros
    else:
        tile = squeeze(_narrow(product(expand(left["m"].iloc[0])[0], expand(right["m"].iloc[0])[0])))
        known = squeeze(left["meta"].iloc[0], right["meta"].iloc[0]) if key[-1] == 0 else None
    return pd.DataFrame({"g": [key[0]], "i": [key[1]], "j": [key[2]], "tile": [tile], "known": [known]})


def _sum(tiles: pd.DataFrame) -> tuple[np.ndarray, tuple, tuple]:
    """A cell's whole scores, and what is known of its anchors and its rows."""
    left, right = expand(next(x for x in tiles["known"] if x is not None))
    return added([expand(t)[0] for t in tiles["tile"] if t is not None]), expand(left), expand(right)


def _frame(found: list[tuple], names: list[str]) -> pd.DataFrame:
    """Found rows, given as tuples of arrays of equal length."""
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*found))} if found else {c: [] for c in names})


_POSITIVE = ["anchor", "anchor_id", "positive", "positive_id", "no_id", "positive_score"]
_NEGATIVE = ["anchor", "place", "negative", "negative_id", "no_id", "negative_score"]


def _best_positives(k: int):
    def run(tiles: pd.DataFrame) -> pd.DataFrame:
        s, (row, order, _, label), (rows, orders, none, labels) = _sum(tiles)
        found = []
        for i in range(len(row)):
            r = np.argsort(-s[i], kind="stable")  # rows are in the order of ids
            best = r[(labels[r] == label[i]) & (rows[r] != row[i])][:k]
            found.append((np.full(len(best), row[i]), np.full(len(best), order[i]), rows[best], orders[best], none[best], s[i, best]))
        return _frame(found, _POSITIVE)

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(tiles: pd.DataFrame) -> pd.DataFrame:
        s, (row, _, _, label, asked), (rows, orders, none, labels) = _sum(tiles)
        found = []
        for i in range(len(row)):
            r = np.argsort(-s[i], kind="stable")
            r = r[labels[r] != label[i]]
            falling = -s[i, r]
            for place, positive in enumerate(asked[i], 1):
                # low * positive <= 100 * negative <= high * positive, in whole numbers of any size
                least, most = -((-low * positive) // 100), (high * positive) // 100
                start, stop = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                best = r[start : min(stop, start + k)]
                found.append((np.full(len(best), row[i]), np.full(len(best), place), rows[best], orders[best], none[best], s[i, best]))
        return _frame(found, _NEGATIVE)

    return run


def _products(anchors: DataFrame, rows: DataFrame, meets: tuple[Column, Column]) -> DataFrame:
    """Partial tiles of each cell: every anchor block meets the row blocks told, chunk by chunk.

    ``meets`` are, for an anchor block and for a row block, the (g, other block) pairs that it is sent to.
    """
    key = ["g", "i", "j", "d"]
    side = lambda t, own, other, to: t.select(F.col("b").alias(own), "d", "meta", "m", F.explode(to).alias("to")).select(F.col("to.g").alias("g"), own, F.col("to.b").alias(other), "d", "meta", "m")
    left, right = side(anchors, "i", "j", meets[0]), side(rows, "j", "i", meets[1])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_multiply, "g int, i int, j int, tile binary, known binary")


def mine(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """For each anchor (rows where ``anchor`` holds) and each of its ``positives`` best rows of its label, the first ``negatives`` rows of
    other labels whose score lies from ``low`` to ``high`` hundredths of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.
    """
    if min(positives, negatives) < 1 or low > high:
        raise ValueError("positives and negatives must be positive, low at most high")
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"), finite.alias("whole"))
    own = pick(own.where("label is not null and v is not null and whole"), "id", "label", "v", "anchor")
    own = own.withColumn("anchor", F.col("anchor") & F.col("id").isNotNull()).withColumn("g", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))
    # pandas would turn ids beside nulls into doubles
    own = own.select("g", "label", "v", "anchor", F.coalesce("id", F.lit(_LAST_ID)).alias("order"), F.col("id").isNull().alias("no_id"))
    rows = scratch.save(own.withColumn("row", F.monotonically_increasing_id()), "rows")

    held, asking = [0] * BUCKETS, [0] * BUCKETS
    for g, n, a in rows.groupBy("g").agg(F.count(F.lit(1)), F.count_if("anchor")).collect():
        held[g], asking[g] = -(-n // BLOCK_ROWS), -(-a // BLOCK_ANCHORS)
    n_anchors = rows.where("anchor").count()
    of = lambda counts: F.element_at(F.array(*map(F.lit, counts)), F.col("g") + 1)
    block = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    pack = lambda t: t.groupBy("g", "b").applyInPandas(lean(_pack(CHUNK_DIMS)), _TILE)
    upto = lambda g, n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(g.alias("g"), b.alias("b")))

    row_tiles = scratch.save(pack(rows.select("g", block(of(held)).alias("b"), "row", "order", "no_id", "label", "v")), "row_tiles")
    near = pack(rows.where("anchor").select("g", block(of(asking)).alias("b"), "row", "order", "no_id", "label", "v"))
    met = row_tiles.where(of(asking) > 0)
    tiles = _products(near, met, (upto(F.col("g"), of(held)), upto(F.col("g"), of(asking))))
    found = tiles.groupBy("g", "i", "j").applyInPandas(lean(_best_positives(positives)), "anchor long, anchor_id long, positive long, positive_id long, no_id boolean, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "no_id", "positive_id", "positive")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    found = scratch.save(found.withColumn("positive_id", F.when(~F.col("no_id"), F.col("positive_id"))).drop("no_id", "positive"), "positives")

    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    # at most ``positives`` scores each
    asked = found.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("asked"))
    far = rows.where("anchor").join(asked, "row")
    far = pack(far.select(F.lit(0).alias("g"), block(F.lit(blocks)).alias("b"), "row", "order", "no_id", "label", "v", "asked"))
    every = F.flatten(F.array(*[upto(F.lit(g), F.lit(n)) for g, n in enumerate(held) if n])) if any(held) else F.expr("cast(array() as array<struct<g int, b int>>)")
    tiles = _products(far, row_tiles, (every, upto(F.col("g"), F.lit(blocks))))
    got = tiles.groupBy("g", "i", "j").applyInPandas(lean(_best_negatives(negatives, low, high)), "anchor long, place int, negative long, negative_id long, no_id boolean, negative_score long")
    window = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "no_id", "negative_id", "negative")
    got = got.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    out = got.join(found, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("no_id"), F.col("negative_id")).alias("negative_id"), "positive_score", "negative_score")
