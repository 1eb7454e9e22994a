"""Term postings, their statistics, BM25, and their upkeep by deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import own_checkpoint_dir


def postings(df: DataFrame, id_col: str, tokens: Column, *carry: str) -> DataFrame:
    """(id, *carry, term, tf): how often each term occurs in each row.

    A row's tokens are sorted and counted within the row, so nothing is shuffled; repeated ids are rows of their own.
    """
    s = df.select(F.col(id_col).alias("id"), *carry, F.array_sort(tokens).alias("_t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    s = s.where(F.size("_t") > 0).select("id", *carry, "_t", starts.alias("_s"))
    runs = F.transform("_s", lambda at, k: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - at).alias("tf")))
    return s.select("id", *carry, F.inline(runs))


def lengths(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, dl): tokens per row, also for rows without any."""
    return df.select(F.col(id_col).alias("id"), F.size(tokens).alias("dl"))


def statistics(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """One row: number of rows, and their mean length (at least 1)."""
    n = lengths(df, id_col, tokens)
    return n.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def roll_up(chunk_postings: DataFrame, owner: str) -> DataFrame:
    """Postings of documents from those of their chunks."""
    return chunk_postings.groupBy(owner, "term").agg(F.sum("tf").cast("int").alias("tf"))


def bm25(df: DataFrame, id_col: str, tokens: Column, query: Sequence[str], k1: float = 1.2, b: float = 0.75, smooth: bool = True) -> DataFrame:
    """(id, score, matched) over the rows given, whose own statistics count.

    The rows are scanned once: each is reduced to its length and its counts of the query's distinct terms before
    anything is shuffled, and what is joined back is one row per term.
    """
    terms = list(dict.fromkeys(query))
    if not terms:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("matched")).where(F.lit(False))
    wanted = F.array(*map(F.lit, terms))
    found = F.filter(F.col("_t"), lambda t: F.array_contains(wanted, t))
    rows = df.select(F.col(id_col).alias("id"), tokens.alias("_t")).select("id", F.size("_t").alias("dl"), found.alias("hits"))
    counts = [F.size(F.filter("hits", lambda h: h == t)).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = rows.select("id", "dl", *counts)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    joined = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(totals))  # totals is one row
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, dfi = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - dfi + 0.5) / (dfi + 0.5))
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest("dl", F.lit(1)) / F.col("avgdl")))
        score = score + F.when(tf > 0, idf * weight).otherwise(0.0)
        matched = matched + (tf > 0).cast("int")
    return joined.select("id", score.alias("score"), matched.alias("matched"))


def bm25_postings(posted: DataFrame, dl: DataFrame, visible: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same score from stored postings: query terms meet ``posted`` first, then only visible ids are kept.

    Lengths of visible ids and their postings of query terms are kept apart, so each table is read once.
    """
    terms = list(dict.fromkeys(query))
    own_checkpoint_dir(dl.sparkSession)
    seen = dl.join(visible.select("id"), "id", "left_semi").checkpoint()
    totals = seen.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    hits = posted.where(F.col("term").isin(terms)).join(seen, "id").checkpoint()
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per query term
    full = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest("dl", F.lit(1)) / F.col("avgdl")))
    return full.groupBy("id").agg(F.sum(idf * weight).alias("score"), F.count(F.lit(1)).cast("int").alias("matched"))


def merge_delta(base: DataFrame, delta: DataFrame, replaced: DataFrame) -> DataFrame:
    """Postings after an increment: replaced ids leave the base, the delta's rows come in."""
    return base.join(replaced, "id", "left_anti").unionByName(delta).where("tf > 0")


def should_compact(deltas: int, replaced: int, total: int, most: int = 8, share: float = 0.35) -> bool:
    return deltas >= most or (total > 0 and replaced / total >= share)


def binding_faults(artifact: DataFrame, records: DataFrame, cover: bool = True) -> DataFrame:
    """(fault, record_id): duplicate, stale and, with ``cover``, missing or extra rows of an artifact bound to records."""
    twice = artifact.groupBy("record_id").count().where("count > 1").select(F.lit("duplicate").alias("fault"), "record_id")
    both = artifact.alias("a").join(records.alias("r"), "record_id")
    stale = both.where(F.col("a.version_id") != F.col("r.version_id")).select(F.lit("stale").alias("fault"), "record_id")
    out = twice.unionByName(stale)
    if cover:
        out = out.unionByName(records.join(artifact, "record_id", "left_anti").select(F.lit("missing").alias("fault"), "record_id"))
        out = out.unionByName(artifact.join(records, "record_id", "left_anti").select(F.lit("extra").alias("fault"), "record_id"))
    return out
