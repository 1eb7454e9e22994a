"""Recall channels over visible records, their fusion, and top-k.

Every channel gives (id, score); :func:`fuse` ranks and joins them. Query-side data are literals, so nothing but the
records is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids, numeric, text

# fixed values: weights of the metadata fields, and of fusion
FIELD_WEIGHTS = {"title": 4.0, "aliases": 3.0, "tags": 3.0, "heading": 2.5, "project_id": 2.0, "path": 1.5, "corpus": 1.0, "metadata": 1.0}
RRF_K = 60
DENSE_FLOOR = 0.18
_RECENT = re.compile(r"\b(latest|recent|newest)\b|最新|最近|近期")


def top(hits: DataFrame, k: int) -> DataFrame:
    """Finite positive scores, best first, ids break ties."""
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") > 0) & (F.col("score") < float("inf"))
    return hits.where(ok).orderBy(F.desc("score"), "id").limit(k)


def _literal(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def metadata(records: DataFrame, query: Sequence[str], weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Sum of field weights of matched terms, over the number of query terms; a field value counts a term once."""
    terms = list(dict.fromkeys(query))
    if not terms:
        return records.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    kinds, total = dict(records.dtypes), F.lit(0.0)
    for field, w in weights.items():
        if field not in kinds:
            continue
        values = F.col(field) if kinds[field].startswith("array") else F.map_values(field) if kinds[field].startswith("map") else F.array(F.col(field).cast("string"))
        # normalized as one text, since only whole columns can be: values hold no unit separator
        glued = F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit(""))), "\x1f")
        values = F.split(text.nfkc(glued), "\x1f")
        per = F.transform(values, lambda v: F.size(F.array_intersect(text.tokens(v), _literal(terms))).cast("double"))
        total = total + w * F.aggregate(per, F.lit(0.0), lambda s, x: s + x)
    return records.select("id", (total / len(terms)).alias("score")).where("score > 0")


def asks_recent(query: str) -> bool:
    return bool(_RECENT.search(query.lower()))


def temporal(records: DataFrame, query: str, now: datetime, prefer: bool | None = None, faithful: bool = True) -> DataFrame:
    """Recency of dated records if the query asks for it, in words or by ``prefer``.

    In the ``faithful`` form an explicit constraint that does not prefer recency scores 1 when the words ask for it.
    """
    inferred = asks_recent(query)
    if not (prefer if prefer is not None else inferred) and not inferred:
        return records.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    flat = prefer is False and inferred and faithful
    score = F.lit(1.0) if flat else numeric.recency(F.lit(now), F.col("modified_at"))
    return records.where(F.col("modified_at").isNotNull()).select("id", score.alias("score"))


def hierarchy(records: DataFrame, query: Sequence[str], seeds: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Share of query terms in hierarchy, heading and path, plus 0.15 per shared ancestor with the best seed."""
    terms = list(dict.fromkeys(query))
    words = text.tokens(F.concat_ws(" ", F.array_join("hierarchy", " "), F.coalesce(F.col("heading"), F.lit("")), "path"), compat=True)
    matched = F.size(F.array_intersect(words, _literal(terms))) if terms else F.lit(0)
    depth = F.lit(0)
    for seed in seeds:
        same = F.lit(0)
        for d in range(len(seed), 0, -1):
            own = F.transform(F.slice("hierarchy", 1, d), lambda x: text.normalize(x))
            want = _literal([" ".join(s.lower().split()) for s in seed[:d]])
            same = F.when((F.size("hierarchy") >= d) & (own == want) & (same == 0), d).otherwise(same)
        depth = F.greatest(depth, same)
    score = matched / max(len(terms), 1) + depth * 0.15
    return records.select("id", score.alias("score")).where("score > 0")


def search_text(records: DataFrame) -> Column:
    """What of a record is embedded: title, heading (empty if none), aliases, tags, hierarchy and content, a line each."""
    lists = [F.array_join(F.col(c), "\n") for c in ("aliases", "tags", "hierarchy") if c in records.columns]
    some = [F.when(F.col(c).isNotNull() & (F.size(c) > 0), x) for c, x in zip([c for c in ("aliases", "tags", "hierarchy") if c in records.columns], lists)]
    heading = F.coalesce(F.col("heading"), F.lit("")) if "heading" in records.columns else F.lit("")
    return F.concat_ws("\n", F.coalesce("title", F.lit("")), heading, *some, F.coalesce("content", F.lit("")))


def dense(vectors: DataFrame, query: Sequence[float], floor: float = DENSE_FLOOR, words: DataFrame | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """Exact cosine with a query vector; (id, values) rows below the floor are left out.

    With ``words`` (id, tokens), as for hashed vectors, a record must also share a token with the query's ``terms``.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.select("id", numeric.cosine(F.col("values"), q).alias("score")).where(F.col("score") >= floor)
    if words is None:
        return found
    return found.join(words.where(F.arrays_overlap("tokens", _literal(list(terms)))).select("id"), "id", "left_semi")


def hashed_vectors(df: DataFrame, id_col: str, tokens: Column, dims: int = 384) -> DataFrame:
    """(id, slot, value): unit feature-hash vectors as sparse rows, ``sum of sign * (1 + ln tf)`` over terms.

    Terms are hashed once per distinct term. Sums by slot and norms share one shuffle by id.
    """
    tf = df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    slot, sign = ids.feature_slot(F.col("term"), dims)
    coded = tf.select("term").distinct().select("term", slot.alias("slot"), sign.alias("sign"))
    rows = tf.join(coded, "term").select("id", "slot", "sign", "tf").repartition("id").groupBy("id", "slot").agg(F.sum(F.col("sign") * (1 + F.log("tf"))).alias("value")).where("value <> 0")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
    return rows.select("id", "slot", (F.col("value") / norm).alias("value"))


def fuse(channels: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = RRF_K, limit: int = 40, visible: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``sum of weight / (k + rank)`` over the channels' first ``limit`` hits.

    Returns (id, fused, best_raw, channels). Hits that are not visible or not positive take no rank; a channel without
    weight takes part with nothing. Ties: the greater raw score, then the id.
    """
    union = None
    for name, hits in channels.items():
        rows = hits.where("score > 0").select(F.lit(name).alias("channel"), "id", "score", F.lit(float((weights or {}).get(name, 1.0))).alias("weight"))
        union = rows if union is None else union.unionByName(rows)
    if visible is not None:
        union = union.join(visible.select("id"), "id", "left_semi")
    w = Window.partitionBy("channel").orderBy(F.desc("score"), "id")
    ranked = union.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).where("weight > 0")
    return ranked.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("fused"), F.max("score").alias("best_raw"), F.array_sort(F.collect_set("channel")).alias("channels"))
