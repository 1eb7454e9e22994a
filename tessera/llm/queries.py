"""The registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, divergence, jaccard, negatives, packing, pieces, quality, sharding, suffix_dedup, token_counts, url_filter, vector_dedup
from tessera.session import table

#: Rules of op2: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
N_SHARDS = 40


def url_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a DataFrame made of literals."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, p, md5(b[p + 1:p + 100]) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
starts AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 100 AS e
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts) GROUP BY doc_id, run),
parts AS (
  SELECT doc_id, s AS pos, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f, s AS t FROM runs
  UNION ALL SELECT doc_id, octet_length(b), coalesce(e, 0), octet_length(b) FROM d LEFT JOIN (SELECT doc_id, max(e) AS e FROM runs GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(hex(b[f + 1:t]), '' ORDER BY pos) AS kept FROM parts JOIN d USING (doc_id) WHERE f < t GROUP BY 1),
cut AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_rules(spark, URL_RULES))


OP2_SQL = (
    "WITH rules(h, p, v) AS (VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
parts AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT r, page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
best AS (
  SELECT r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM split LEFT JOIN best USING (r)"""
)


#: The tokenizer of op3, by its name among the public vocabulary files.
PACKING_VOCABULARY = "word_bpe_49k.json"
#: The vocabulary of op10 and op11.
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = f"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
seen AS (
  SELECT base.*, perspective,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM base JOIN people ON base.conv_id IS NOT DISTINCT FROM people.conv_id),
head AS (
  SELECT *, '{chat.START}' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header FROM seen),
text AS (SELECT *, header || content || '{chat.END.strip()}' || chr(10) AS rendered FROM head),
placed AS (
  SELECT *, row_number() OVER w AS n, sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS char_end
  FROM text WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content))
SELECT conv_id, perspective, CAST(n - 1 AS INTEGER) AS segment, CAST(turn AS BIGINT) AS turn, speaker, role, rendered,
       CAST(char_end - length(rendered) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
       CAST(CASE WHEN role = 'assistant' THEN char_end - length(rendered) + length(header) ELSE char_end END AS BIGINT) AS loss_start,
       CAST(char_end AS BIGINT) AS loss_end, CAST(role = 'assistant' AS INTEGER) AS mask
FROM placed"""


def op7_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 END),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY 1), counts AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept
FROM embeddings LEFT JOIN least_of ON least_of.x = vec_id LEFT JOIN counts ON counts.x = vec_id"""


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) ON x = w.doc_id"""


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(vocabulary(PIECE_VOCABULARY)))


OP9_SQL = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t),
rows AS (
  SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
         CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
         xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS text_crc32
  FROM documents, bits),
scored AS (
  SELECT *, list_transform(range({N_SHARDS + 1}), lambda k: -1 / ln((CAST('0x' || substr(md5(key || ':' || k), 1, 13) AS BIGINT) + 0.5) / {2**52})) AS s FROM rows),
placed AS (
  SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
         CAST(list_position(s[1:{N_SHARDS}], list_max(s[1:{N_SHARDS}])) - 1 AS INTEGER) AS shard,
         CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS grown_shard,
         CAST('0x' || substr(md5(key || ':' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.SLOT_BUCKETS} AS bucket
  FROM scored)
SELECT doc_id, size, text_crc32, law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM placed"""


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT d) AS docs FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
held AS (SELECT lang, source, term, n, total FROM counts JOIN kept USING (lang, term)),
whole AS (SELECT lang, sum(total)::HUGEINT + count(*) AS w FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sized AS (
  SELECT g.lang, g.source, coalesce(s.n, 0)::HUGEINT + coalesce(v.v, 0) AS w
  FROM groups g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM held GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) v ON g.lang = v.lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 1) // g.w AS p,
         1 + 1000000000::HUGEINT * (k.total + 1) // whole.w AS q
  FROM sized g JOIN kept k ON g.lang = k.lang JOIN whole ON whole.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term
QUALIFY rank <= 200"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, b.r AS b, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, 1 + least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS s
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positive AS (
  SELECT a, anchor_id, vec_id AS positive_id, b, s AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.s AS negative_score
FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 80 * p.positive_score <= 100 * n.s AND 100 * n.s <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.vec_id) <= 5"""

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_suffix_dedup": (op1_suffix_dedup, OP1_SQL),
    "op2_url_filter": (op2_url_filter, OP2_SQL),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_posting_lists": (op4_posting_lists, None),
    "op5_quality": (op5_quality, None),
    "op6_chat_rotation": (op6_chat_rotation, OP6_SQL),
    "op7_subspace_join": (op7_subspace_join, OP7_SQL),
    "op8_jaccard": (op8_jaccard, OP8_SQL),
    "op9_rendezvous": (op9_rendezvous, OP9_SQL),
    "op10_sentencepiece": (op10_sentencepiece, None),
    "op11_token_counts": (op11_token_counts, None),
    "op12_source_divergence": (op12_source_divergence, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries by name."""
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
