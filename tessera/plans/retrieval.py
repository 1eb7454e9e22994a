"""Queries over records: visibility, term statistics, the recall channels and their fusion."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric, text
from tessera.operators import channels, lexical, postings, selection, visibility
from tessera.plans.inputs import RECORDS_SQL, TOKENS_SQL, records
from tessera.plans.registry import query
from tessera.session import table

TERMS = ["the", "blewh", "thing", "que"]
SOURCES = [f"src{i}" for i in range(12)]
NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCOPE = visibility.Scope("project", SOURCES, ["p1"], exclude=["src3"], after=datetime(2020, 1, 2), before=datetime(2025, 6, 1))
_TOK = TOKENS_SQL.format("content")
_VISIBLE = f"""visible AS (
  SELECT * FROM records WHERE retrieval_scope IN ('default', 'project') AND source_id IN ({", ".join(f"'{s}'" for s in SOURCES)})
    AND CASE WHEN project_id IS NULL THEN retrieval_scope <> 'project' ELSE project_id = 'p1' END
    AND NOT starts_with(path, 'src3/') AND modified_at BETWEEN TIMESTAMP '2020-01-02' AND TIMESTAMP '2025-06-01')"""
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.visible_records(records(spark, sf_dir), SCOPE)


def _tokens(column: str = "content"):
    return text.tokens(F.col(column), cjk=False)


@query("visible_records", f"WITH {RECORDS_SQL}, {_VISIBLE} SELECT id, source_id, retrieval_scope, project_id FROM visible")
def visible_records(spark, sf_dir):
    return _visible(spark, sf_dir).select("id", "source_id", "retrieval_scope", "project_id")


_PRINCIPAL = visibility.Principal(("default", "history"), SOURCES[:5], ["p1", "p2"])


@query("source_status", f"""WITH {RECORDS_SQL} SELECT source_id, count(*) AS records, count(DISTINCT document_id) AS documents FROM records
WHERE source_id IN ({", ".join(f"'{s}'" for s in SOURCES[:5])}) AND retrieval_scope IN ('default', 'history')
  AND (project_id IS NULL OR project_id IN ('p1', 'p2')) GROUP BY 1""")
def source_status(spark, sf_dir):
    return visibility.status_counts(records(spark, sf_dir), _PRINCIPAL)


@query("token_frequency", f"WITH {RECORDS_SQL}, t AS (SELECT id, unnest({_TOK}) AS term FROM records) SELECT id, term, CAST(count(*) AS INTEGER) AS tf FROM t GROUP BY 1, 2")
def token_frequency(spark, sf_dir):
    return postings.postings(records(spark, sf_dir), "id", _tokens())


@query("document_frequency", f"WITH {RECORDS_SQL}, t AS (SELECT id, unnest({_TOK}) AS term FROM records) SELECT term, count(DISTINCT id) AS df FROM t GROUP BY 1")
def document_frequency(spark, sf_dir):
    return postings.document_frequency(postings.postings(records(spark, sf_dir), "id", _tokens()))


@query("doc_length_stats", f"WITH {RECORDS_SQL} SELECT count(*) AS n, round(greatest(avg(len({_TOK})), 1.0), 6) AS avgdl FROM records")
def doc_length_stats(spark, sf_dir):
    return postings.statistics(records(spark, sf_dir), "id", _tokens()).select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25_sql(rows: str) -> str:
    return f"""tok AS (SELECT id, {_TOK} AS t FROM {rows}),
stat AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM tok),
tf AS (SELECT id, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf, len(t) AS dl FROM tok, (SELECT unnest({_LIST}) AS term) q),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1),
bm25 AS (
  SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score, count(*) AS matched
  FROM tf JOIN df USING (term), stat WHERE tf > 0 GROUP BY 1)"""


@query("bm25_scores", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_bm25_sql('visible')} SELECT id, round(score, 6) AS score, CAST(matched AS INTEGER) AS matched FROM bm25")
def bm25_scores(spark, sf_dir):
    return postings.bm25(_visible(spark, sf_dir), "id", _tokens(), TERMS).select("id", F.round("score", 6).alias("score"), "matched")


@query("bm25_postings", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_bm25_sql('visible')} SELECT id, round(score, 6) AS score, CAST(matched AS INTEGER) AS matched FROM bm25")
def bm25_postings(spark, sf_dir):
    r = records(spark, sf_dir)
    posted, dl = postings.postings(r, "id", _tokens()), postings.lengths(r, "id", _tokens())
    return postings.bm25_postings(posted, dl, _visible(spark, sf_dir), TERMS).select("id", F.round("score", 6).alias("score"), "matched")


@query("bm25_topk", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_bm25_sql('visible')} SELECT id, round(score, 6) AS score FROM bm25 WHERE score > 0 ORDER BY bm25.score DESC, id LIMIT 40")
def bm25_topk(spark, sf_dir):
    return channels.top(postings.bm25(_visible(spark, sf_dir), "id", _tokens(), TERMS), 40).select("id", F.round("score", 6).alias("score"))


_META_QUERY = ["en", "src1", "the", "thing", "md"]
_META_LIST = "[" + ", ".join(f"'{t}'" for t in _META_QUERY) + "]"
_META_SQL = f"""meta AS (
  SELECT id, (4.0 * len(list_intersect({TOKENS_SQL.format('title')}, {_META_LIST})) + 3.0 * len(list_intersect(list_concat([], tags), {_META_LIST}))
    + 2.0 * len(list_intersect({TOKENS_SQL.format("coalesce(project_id, '')")}, {_META_LIST})) + 1.5 * len(list_intersect({TOKENS_SQL.format('path')}, {_META_LIST}))) / {len(_META_QUERY)} AS score
  FROM visible)"""


@query("metadata_channel", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_META_SQL} SELECT id, round(score, 6) AS score FROM meta WHERE score > 0")
def metadata_channel(spark, sf_dir):
    return channels.metadata(_visible(spark, sf_dir), _META_QUERY).select("id", F.round("score", 6).alias("score"))


_TEMPORAL_SQL = "temporal AS (SELECT id, 1 / (1 + greatest(0, epoch_ms(TIMESTAMP '2026-01-01') - epoch_ms(modified_at)) / 86400000.0 / 30) AS score FROM visible WHERE modified_at IS NOT NULL)"


@query("temporal_channel", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_TEMPORAL_SQL} SELECT id, round(score, 6) AS score FROM temporal")
def temporal_channel(spark, sf_dir):
    return channels.temporal(_visible(spark, sf_dir), "the latest thing", NOW).select("id", F.round("score", 6).alias("score"))


_HIERARCHY_SQL = f"""hier AS (
  SELECT id, len(list_intersect(list_concat(list_concat([source_id], [hierarchy[2]]), {TOKENS_SQL.format('path')}), {_META_LIST})) / {float(len(_META_QUERY))}
    + 0.15 * CASE WHEN source_id = 'src1' AND hierarchy[2] = 'en' THEN 2 WHEN source_id = 'src1' THEN 1 ELSE 0 END AS score FROM visible)"""


@query("hierarchy_channel", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_HIERARCHY_SQL} SELECT id, round(score, 6) AS score FROM hier WHERE score > 0")
def hierarchy_channel(spark, sf_dir):
    return channels.hierarchy(_visible(spark, sf_dir), _META_QUERY, [["src1", "en"]]).select("id", F.round("score", 6).alias("score"))


_PROBE = [((i * 37) % 17 - 8) / 10 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _PROBE) + "]"
_DENSE_SQL = f"""dense AS (
  SELECT vec_id AS id, list_inner_product(CAST(embedding AS DOUBLE[]), {_PROBE_SQL}) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product({_PROBE_SQL}, {_PROBE_SQL})) AS score
  FROM embeddings WHERE embedding IS NOT NULL)"""


def _dense(spark, sf_dir):
    return channels.dense(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")), _PROBE)


@query("dense_channel", f"WITH {_DENSE_SQL} SELECT id, round(score, 6) AS score FROM dense WHERE score >= 0.18")
def dense_channel(spark, sf_dir):
    return _dense(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query("dense_topk", f"WITH {_DENSE_SQL} SELECT id, round(score, 6) AS score FROM dense WHERE score >= 0.18 ORDER BY dense.score DESC, id LIMIT 20")
def dense_topk(spark, sf_dir):
    return channels.top(_dense(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))


_RRF_SQL = f"""hits AS (
  SELECT 'bm25' AS channel, id, score, 1.0 AS weight FROM bm25 UNION ALL SELECT 'metadata', id, score, 0.5 FROM meta WHERE score > 0
  UNION ALL SELECT 'temporal', id, score, 0.25 FROM temporal UNION ALL SELECT 'hierarchy', id, score, 1.0 FROM hier WHERE score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(score, 9) DESC, id) AS r FROM hits),
fused AS (SELECT id, sum(weight / (60 + r)) AS fused, max(score) AS best_raw, list_sort(list(channel)) AS channels FROM ranked WHERE r <= 40 GROUP BY 1)"""


def _fused(spark, sf_dir):
    v = _visible(spark, sf_dir)
    found = {
        "bm25": postings.bm25(v, "id", _tokens(), TERMS).drop("matched"),
        "metadata": channels.metadata(v, _META_QUERY),
        "temporal": channels.temporal(v, "the latest thing", NOW),
        "hierarchy": channels.hierarchy(v, _META_QUERY, [["src1", "en"]]),
    }
    rounded = {k: d.withColumn("score", F.round("score", 9)) for k, d in found.items()}
    return channels.fuse(rounded, {"metadata": 0.5, "temporal": 0.25})


@query("rrf_fusion", f"WITH {RECORDS_SQL}, {_VISIBLE}, {_bm25_sql('visible')}, {_META_SQL}, {_TEMPORAL_SQL}, {_HIERARCHY_SQL}, {_RRF_SQL} SELECT id, round(fused, 6) AS fused, round(best_raw, 6) AS best_raw, array_to_string(channels, ',') AS channels FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", F.round("fused", 6).alias("fused"), F.round("best_raw", 6).alias("best_raw"), F.array_join("channels", ",").alias("channels"))


@query("feature_hash_embedding", f"""WITH {RECORDS_SQL}, t AS (SELECT id, unnest({_TOK}) AS term FROM records WHERE id % 1 = 0),
tf AS (SELECT id, term, count(*) AS n FROM t GROUP BY 1, 2),
coded AS (
  SELECT term, list_reduce(list_transform(string_split(term, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h,
         list_reduce(list_transform(string_split(term, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2654435769 AS BIGINT)) AS g
  FROM (SELECT DISTINCT term FROM tf)),
slots AS (SELECT id, CAST(h % 384 AS INTEGER) AS slot, sum(CASE WHEN g % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(n))) AS v FROM tf JOIN coded USING (term) GROUP BY 1, 2)
SELECT id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) + 0.0 AS value FROM slots WHERE v <> 0""".replace(" WHERE id % 1 = 0", ""))
def feature_hash_embedding(spark, sf_dir):
    return channels.hashed_vectors(records(spark, sf_dir), "id", _tokens()).select("id", "slot", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("mmr_select")
def mmr_select(spark, sf_dir):
    """Diverse picks of the fused candidates; one query, at most 160 rows."""
    r = records(spark, sf_dir).select("id", "content")
    found = _fused(spark, sf_dir).join(r, "id").select(F.lit(1).alias("query_id"), "id", "content", F.col("fused").alias("score"))
    return selection.select_groups(found, 20)


@query("extractive_compress")
def extractive_compress(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "content")
    return selection.compress_column(r, "content", " ".join(TERMS), 500).select("id", "excerpt", "compressed")


@query("sentence_split", f"""WITH {RECORDS_SQL} SELECT id, CAST(len(list_filter(list_transform(regexp_extract_all(content, '[^.!?。！？\\n]+[.!?。！？]?'), lambda s: trim(s, ' ')), lambda s: s <> '')) AS INTEGER) AS sentences FROM records""")
def sentence_split(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.size(text.sentences(F.col("content"))).alias("sentences"))


@query("cosine_to_centroid", """WITH mean AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM mean GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS cosine FROM embeddings JOIN c USING (label)""")
def cosine_to_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(c, "label").select("vec_id", "label", F.round(numeric.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))


_LEX = ["blewh", "thing", "ouen"]
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_LEX_SQL = "list_filter(regexp_extract_all(regexp_replace(lower({}), '[-._/\\\\]+', ' ', 'g'), '[a-z0-9][a-z0-9+]*(?:''[a-z0-9]+)?'), lambda w: (length(w) > 1 OR regexp_matches(w, '^[0-9]+$')) AND NOT list_contains(" + _STOP + ", w))"


@query("lexical_tokens", f"WITH {RECORDS_SQL}, t AS (SELECT id, unnest({_LEX_SQL.format('content')}) AS term FROM records) SELECT id, count(*) AS tokens, count(DISTINCT term) AS terms FROM t GROUP BY 1")
def lexical_tokens(spark, sf_dir):
    t = records(spark, sf_dir).select("id", text.lexical_tokens(F.col("content")).alias("t")).where(F.size("t") > 0)
    return t.select("id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


def notes_and_chunks(spark, sf_dir):
    """Notes with paragraph chunks, for the lexical search."""
    r = records(spark, sf_dir)
    notes = r.select("id", "path", "title", "aliases", "tags", F.array().cast("array<string>").alias("headings"))
    parts = r.select("id", F.posexplode(F.split("content", "\n")).alias("chunk", "content"))
    return notes, parts


@query("lexical_search", f"""WITH {RECORDS_SQL},
parts AS (SELECT id, unnest(range(len(s))) AS chunk, unnest(s) AS content FROM (SELECT id, string_split(content, chr(10)) AS s FROM records)),
q AS (SELECT unnest({_LEX!r}) AS term),
tok AS (SELECT id, chunk, content, {_LEX_SQL.format('content')} AS t FROM parts),
stat AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM tok WHERE len(t) > 0),
tf AS (SELECT id, chunk, term, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS dl FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1),
meta AS (SELECT id, term, list_contains({_LEX_SQL.format('title')}, term) AS ti, list_contains({_LEX_SQL.format("array_to_string(tags, ' ')")}, term) AS ta, list_contains({_LEX_SQL.format('path')}, term) AS pa FROM records, q),
note AS (SELECT id, sum(1.4 * CAST(ti AS INT) + CAST(ta AS INT) + 0.35 * CAST(pa AS INT)) AS weight, bool_or(ti OR ta) AS strong, list(term) FILTER (ti OR ta OR pa) AS mt FROM meta GROUP BY 1),
hits AS (SELECT id, term FROM tf WHERE tf > 0 UNION SELECT id, term FROM meta WHERE ti OR ta OR pa),
rare AS (SELECT term, count(*) <= greatest(4, ceil((SELECT count(*) FROM records) * 0.02)) AS rare FROM hits GROUP BY 1),
cand AS (SELECT id FROM hits JOIN rare USING (term) JOIN note USING (id) GROUP BY id HAVING count(*) >= 2 OR bool_or(strong) OR bool_or(rare)),
scored AS (
  SELECT tf.id, tf.chunk, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) + any_value(weight)
         + CASE WHEN any_value(p.hit) THEN 1.1 WHEN any_value(m.hit) THEN 1.4 ELSE 0 END AS score,
         count(*) FILTER (tf > 0 OR list_contains(coalesce(mt, []), tf.term)) AS matched, any_value(p.hit) AS body, any_value(m.hit OR strong OR len(coalesce(mt, [])) >= 2) AS strong,
         bool_or(coalesce(rare, false) AND (tf > 0 OR list_contains(coalesce(mt, []), tf.term))) AS rare
  FROM tf JOIN df USING (term) JOIN note USING (id) JOIN cand USING (id) LEFT JOIN rare USING (term)
  JOIN (SELECT id, chunk, regexp_matches(regexp_replace(lower(content), '\\s+', ' ', 'g'), '(?:^|[^a-z0-9]){" ".join(_LEX)}(?:$|[^a-z0-9])') AS hit FROM parts) p ON p.id = tf.id AND p.chunk = tf.chunk
  JOIN (SELECT id, regexp_matches(lower(title), '(?:^|[^a-z0-9]){" ".join(_LEX)}(?:$|[^a-z0-9])') AS hit FROM records) m ON m.id = tf.id, stat
  GROUP BY tf.id, tf.chunk)
SELECT id, CAST(chunk AS INTEGER) AS chunk, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS r FROM scored WHERE (matched >= 2 OR body OR strong OR rare) AND score >= 0.2) WHERE r = 1""".replace("{" + "}", ""))
def lexical_search(spark, sf_dir):
    notes, parts = notes_and_chunks(spark, sf_dir)
    return lexical.search(notes, parts, " ".join(_LEX)).select("id", "chunk", F.round("score", 6).alias("score"))
