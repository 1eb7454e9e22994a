"""Exact duplicates, canonical choices, quarantine, and Jaccard-close records."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def duplicates(df: DataFrame, key: Column, order: Sequence[Column | str], id_col: str) -> DataFrame:
    """(id, duplicate_of): the first row of each key by ``order`` (then id) stands for the others; null for itself.

    Only keys and order columns go through the shuffle; the first row of each key is found by an aggregate, so a
    frequent key is combined before it.
    """
    rank = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate([*order, F.col(id_col)])])
    rows = df.select(F.col(id_col).alias("id"), key.alias("_key"), rank.alias("_rank"))
    first = rows.groupBy("_key").agg(F.min_by("id", "_rank").alias("first"))
    out = rows.join(first, "_key", "left")
    return out.select("id", F.when(F.col("first") != F.col("id"), F.col("first")).alias("duplicate_of"))


def quarantine(df: DataFrame, control: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """Rows of ``df`` none of whose hash columns equals that of a control row."""
    out = df
    for h in hashes:
        out = out.join(control.select(F.col(h)).where(F.col(h).isNotNull()).distinct(), h, "left_anti")
    return out


def _bands(n: Column, at_least: float) -> Column:
    """Bands of sizes, such that the sizes of two sets that are ``at_least`` as similar lie in one band or in neighbours."""
    return F.floor(F.log(n) / F.lit(_band_width(at_least))).cast("long")


def _band_width(at_least: float) -> float:
    return max(-math.log(at_least) * (1 + 1e-9), 1e-9)


def _signatures(s: Column, band: Column, at_least: float) -> Column:
    """Hashes of the buckets of a sorted set of 64-bit hashes, in a number of buckets that is fixed by the band.

    Where the smaller of two similar sets lies in the band, fewer elements than there are buckets are in only one of
    them, so the two agree in a bucket. An empty bucket counts, too.
    """
    apart = (1 - at_least) / at_least * F.exp(F.lit(_band_width(at_least)) * (band + 1))

    def of(v: Column) -> Column:
        m, s = v["m"], v["s"]
        bucket = lambda h: F.shiftright((F.shiftright(h, 33) + (1 << 30)) * m, 31)
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (bucket(F.get(s, i - 1)) != bucket(F.get(s, F.greatest(i - 2, F.lit(0))))))
        full = lambda at: F.transform(at, lambda p, j: F.xxhash64(v["band"], F.slice(s, p, F.coalesce(F.get(at, j + 1), F.size(s) + 1) - p)))
        held = F.transform(starts, lambda p: bucket(F.get(s, p - 1)))
        empty = F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), m - 1), held), lambda b: F.xxhash64(v["band"], m, b))
        return F.concat(text.let(starts, full), empty)

    return text.let(F.struct(s.alias("s"), band.alias("band"), (F.floor(apart + 1e-6) + 1).cast("long").alias("m")), of)


def close_candidates(classes: DataFrame, at_least: float) -> DataFrame:
    """(x_id, y_id), among them all pairs of sets (id, s: sorted 64-bit hashes) that are at least so similar."""
    band = _bands(F.size("s"), at_least)
    # explode_outer, as the filter that Spark infers from explode would reach below the shuffle and make it another one
    slim = classes.select("id", F.size("s").alias("n"), F.explode_outer(F.concat(_signatures(F.col("s"), band, at_least), _signatures(F.col("s"), band - 1, at_least))).alias("h"))
    x, y = (slim.select(*[F.col(c).alias(f"{p}_{c}") for c in slim.columns]) for p in "xy")
    near = (F.col("x_id") < F.col("y_id")) & (F.least("x_n", "y_n") >= at_least * F.greatest("x_n", "y_n") - 1e-9)
    return x.join(y, (F.col("x_h") == F.col("y_h")) & near).select("x_id", "y_id").distinct()


def close_pairs(df: DataFrame, id_col: str, tokens: Column, at_least: float = 0.92, width: int = 3) -> DataFrame:
    """(a, b, similarity) of records whose word-shingle sets are at least so similar.

    Sets are hashed and cut into so many buckets that two such sets agree in one (after PartEnum, Arasu et al., 2006).
    A bucket holds about ``at_least / (1 - at_least)`` shingles, so a passage that many records share brings together
    only those that hold little else. Records with equal sets are compared once, as (least id of the set, other id), and as class pairs.
    """
    sets = df.select(F.col(id_col).alias("id"), F.sort_array(F.transform(text.shingles(tokens, width), lambda s: F.xxhash64(s))).alias("s")).where(F.size("s") > 0)
    # one shuffle of the sets, which all that follows reads
    seen = sets.select("id", "s", F.min("id").over(Window.partitionBy(F.xxhash64("s"), "s")).alias("first"))
    classes = seen.where("id = first").select("id", "s")
    copies = seen.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    pairs = close_candidates(classes, at_least)
    full = lambda c: classes.select(F.col("id").alias(f"{c}_id"), F.col("s").alias(f"{c}_s"))
    both = pairs.join(full("x"), "x_id").join(full("y"), "y_id")
    scored = both.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), text.jaccard(F.col("x_s"), F.col("y_s")).alias("similarity")).where(F.col("similarity") >= at_least)
    return scored.unionByName(copies)


def mode_value(df: DataFrame, group: str, value: str, strict: bool = False) -> DataFrame:
    """(group, value, n) of each group's most frequent value, ties by value; ``strict`` asks for over half."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"), F.sum("n").alias("_total"))
    return (best.where(F.col("n") * 2 > F.col("_total")) if strict else best).drop("_total")


def stable_ordinals(current: DataFrame, previous: DataFrame, path: str = "path") -> DataFrame:
    """(path, ordinal): earlier ordinals stay, new paths follow in their order.

    New paths are numbered within ranges whose bounds are some 256 of the paths, chosen by hash, so that no task holds
    them all and a repeated task finds the same ranges.
    """
    kept = current.select(path).join(previous.select(path, "ordinal"), path, "left")
    new = kept.where(F.col("ordinal").isNull()).select(path)
    every = max(1, new.count() // 256)
    bounds = sorted(r[0] for r in new.where((F.pmod(F.xxhash64(path), F.lit(every)) == 0) & F.col(path).isNotNull()).distinct().limit(4096).collect())
    held = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
    ranged = new.withColumn("_p", F.size(F.filter(held, lambda b: b <= F.col(path))))
    start = previous.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("_start"))
    counts = ranged.groupBy("_p").count()
    before = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per range
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(path))).join(F.broadcast(before), "_p").crossJoin(F.broadcast(start))
    numbered = numbered.select(path, (F.col("_start") + F.col("_before") + F.col("_n") - 1).cast("long").alias("ordinal"))
    return kept.where(F.col("ordinal").isNotNull()).select(path, F.col("ordinal").cast("long").alias("ordinal")).unionByName(numbered)


def changes(previous: DataFrame, current: DataFrame, path: str = "path", digest: str = "content_sha256") -> DataFrame:
    """(path, change): insert, update, reuse or tombstone."""
    p, c = previous.select(F.col(path).alias("path"), F.col(digest).alias("_old")), current.select(F.col(path).alias("path"), F.col(digest).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "tombstone").when(F.col("_old") == F.col("_new"), "reuse").otherwise("update")
    return p.join(c, "path", "full_outer").select("path", kind.alias("change"))


def broken_links(rows: DataFrame, order: str, previous: str, own: str, chain: str | None = None) -> DataFrame:
    """Rows of a hash chain whose ``previous`` is not the hash of the row before; the first row's is empty."""
    w = Window.partitionBy(*([chain] if chain else [F.lit(0)])).orderBy(order)
    return rows.withColumn("_want", F.coalesce(F.lag(own).over(w), F.lit(""))).where(F.coalesce(F.col(previous), F.lit("")) != F.col("_want")).drop("_want")
