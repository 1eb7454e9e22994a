"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only.

Each record goes to the shard with the best score ``-weight / ln(u)``, where ``u`` in (0, 1) comes from the MD5 of
the key and the shard's number. A record's score for a shard does not depend on the other shards, so one more shard
takes records only into itself, about its share of them.

Defined cases: a null key counts as the text ``null``; equal keys go to one shard; a null text has size 16 and the
checksum of nothing; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a shard are counted in this many separately sorted buckets, so that no task holds a whole shard.
SLOT_BUCKETS = 1024
_SPAN = 2.0**52


def _digits(c: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")


def best_shard(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """STRUCT<s, k>: the best score of ``key`` among shards ``first`` and on, and minus its shard; the lower number wins a tie."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    u = lambda k: (_digits(F.concat_ws(":", text, F.lit(str(k))), 13) + F.lit(0.5)) / F.lit(_SPAN)
    scores = [F.struct((F.lit(-float(w)) / F.log(u(k))).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(weights, first)]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: 0 to ``len(weights) - 1``."""
    return (-best_shard(key, weights)["k"]).cast("int")


def with_slots(df: DataFrame, shard: str, bucket: Column, order: Sequence[Column], slot: str) -> DataFrame:
    """Adds a gapless place from 0 within each shard: by bucket, then by ``order``.

    Rows are numbered within (shard, bucket); the buckets' offsets are sums over their counts. Both sides of the
    join are dealt out by (shard, bucket), so the rows move once.
    """
    keyed = df.withColumn("_bucket", bucket)
    own = Window.partitionBy(shard, "_bucket")
    numbered = keyed.withColumn("_n", F.row_number().over(own.orderBy(*order)))
    counts = keyed.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_at"))
    joined = numbered.join(offsets.hint("shuffle_merge"), [shard, "_bucket"])
    return joined.withColumn(slot, (F.col("_at") + F.col("_n") - 1).cast("long")).drop("_bucket", "_n", "_c", "_at")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place in it, size and checksum of each document; ``grown_shard`` is its shard under ``grown``.

    The text never moves: only its size and checksum go through the shuffle.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    joins = len(grown) > len(weights) and list(grown[: len(weights)]) == list(weights)
    raw = F.coalesce(F.encode(text, "utf-8"), F.lit("").cast("binary"))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        best_shard(key, weights).alias("_best"),
        # shards that only join need no second look at the others
        (best_shard(key, grown[len(weights) :], len(weights)) if joins else best_shard(key, grown)).alias("_grown"),
    )
    grown_shard = F.when(F.col("_grown.s") > F.col("_best.s"), -F.col("_grown.k")).otherwise(-F.col("_best.k")) if joins else -F.col("_grown.k")
    rows = rows.select("doc_id", "size", "text_crc32", "law", (-F.col("_best.k")).cast("int").alias("shard"), grown_shard.cast("int").alias("grown_shard"))
    salt = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    bucket = F.pmod(_digits(salt, 8), F.lit(SLOT_BUCKETS)).cast("int")
    placed = with_slots(rows, "shard", bucket, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
