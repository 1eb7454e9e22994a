"""Queries over topic groups, labels and display attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import topics
from tessera.plans.registry import query
from tessera.session import table


def _docs(spark, sf_dir):
    i = F.col("doc_id")
    path = F.when(i % 12 == 0, "a/cache/x.md").when(i % 12 == 1, "a/README-old.md").when(i % 12 == 2, "b/._x.md").otherwise(F.concat(F.lit("c/"), i.cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "documents").select(i.alias("id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), (i % 15 == 0).alias("graph_exclude"), F.when(i % 30 == 0, "by hand").alias("graph_exclude_reason"))


@query("graph_effective_documents", """WITH j AS (SELECT doc_id AS id, coalesce(text, '') AS t, CASE WHEN doc_id % 12 = 2 THEN 'AppleDouble metadata' WHEN doc_id % 15 = 0 THEN CASE WHEN doc_id % 30 = 0 THEN 'by hand' ELSE 'frontmatter graph_exclude' END
  WHEN doc_id % 12 = 0 THEN 'system or generated path' WHEN doc_id % 12 = 1 THEN 'README-old document' WHEN length(regexp_replace(coalesce(text, ''), '[^0-9A-Za-z㐀-鿿]+', '', 'g')) = 0 THEN 'empty document' END AS reason FROM documents),
c AS (SELECT id, trim(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g'), chr(10) || ' ' || chr(9)) AS c FROM j WHERE reason IS NULL), f AS (SELECT id, min(id) OVER (PARTITION BY c) AS first FROM c)
SELECT j.id, coalesce(reason, CASE WHEN first <> j.id THEN 'duplicate of ' || first END) AS reason FROM j LEFT JOIN f ON f.id = j.id""")
def graph_effective_documents(spark, sf_dir):
    return topics.effective(_docs(spark, sf_dir))


@query("group_visibility", """WITH d AS (SELECT o_orderkey AS id, o_orderpriority AS grp, o_custkey % 40 AS canonical, o_orderkey % 9 = 0 AS supporting FROM orders),
f AS (SELECT grp, canonical, min(id) AS first FROM d WHERE NOT supporting GROUP BY 1, 2)
SELECT id, CAST(CASE WHEN supporting THEN 0.3 WHEN id <> first THEN 0.36 ELSE 0.86 END AS DOUBLE) AS display_weight, CAST(CASE WHEN supporting THEN 0.008 WHEN id <> first THEN 0.012 ELSE 0.2 END AS DOUBLE) AS community_weight,
  CASE WHEN NOT supporting AND id <> first THEN first END AS duplicate_of FROM d LEFT JOIN f USING (grp, canonical)""")
def group_visibility(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return topics.visibility_weights(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 40).alias("canonical"), (F.col("o_orderkey") % 9 == 0).alias("supporting")))


@query("community_labels", """WITH m AS (SELECT c_nationkey AS community, c_custkey AS node, CASE WHEN c_custkey % 6 = 0 THEN 'proj' || (c_custkey % 18) END AS project, c_custkey % 4 = 1 AS prio FROM customer),
s AS (SELECT community, count(*) AS n FROM m GROUP BY 1), p AS (SELECT community, project AS term, count(*) AS s FROM m WHERE project IS NOT NULL GROUP BY 1, 2), q AS (SELECT community, count(*) AS s FROM m WHERE prio GROUP BY 1),
t AS (SELECT m.community, o_orderpriority AS term, count(*) AS s FROM m JOIN orders ON o_custkey = node GROUP BY 1, 2),
bp AS (SELECT community, term, s FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY s DESC, term) AS r FROM p) WHERE r = 1), bt AS (SELECT community, term FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY s DESC, term) AS r FROM t) WHERE r = 1)
SELECT s.community, coalesce(CASE WHEN bp.s >= greatest(2, ceil(n * 0.15)) THEN bp.term END, CASE WHEN q.s >= greatest(2, ceil(n * 0.25)) THEN 'urgent' END, bt.term, 'Community') AS label FROM s LEFT JOIN bp USING (community) LEFT JOIN q USING (community) LEFT JOIN bt USING (community)""")
def community_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    members = c.select(F.col("c_nationkey").alias("community"), k.alias("node"), F.when(k % 6 == 0, F.concat(F.lit("proj"), (k % 18).cast("string"))).alias("project"), F.when(k % 4 == 1, F.array(F.lit("urgent"))).otherwise(F.array().cast("array<string>")).alias("priority"))
    terms = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("term"), F.lit(1.0).alias("w"))
    return topics.community_labels(members, terms).select("community", "label")


@query("distinct_labels", """WITH l AS (SELECT n_nationkey AS community, 'g' || (n_nationkey % 6) AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'k' || (n_nationkey % 4) END AS k FROM nation), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY community) AS n FROM l),
f AS (SELECT *, CASE WHEN n = 1 THEN label WHEN k IS NOT NULL THEN label || ' · ' || k ELSE label || ' ' || n END AS final FROM n)
SELECT community, CASE WHEN row_number() OVER (PARTITION BY final ORDER BY community) = 1 THEN final ELSE final || ' ' || n END AS label FROM f""")
def distinct_labels(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("community"), F.concat(F.lit("g"), (k % 6).cast("string")).alias("label"), F.when(k % 2 == 0, F.array(F.concat(F.lit("k"), (k % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("keywords"))
    return topics.distinct_labels(rows)


@query("display_attributes", """SELECT c_custkey AS node, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CAST(c_nationkey AS VARCHAR)) AS category, coalesce(CASE WHEN c_custkey % 2 = 0 THEN '#102030' END, '#94A3B8') AS color,
CAST(CASE WHEN coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CAST(c_nationkey AS VARCHAR)) IN ('BUILDING', '7') THEN 1.0 ELSE 0.12 END AS DOUBLE) AS alpha FROM customer""")
def display_attributes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    nodes = c.select(k.alias("node"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("topic"), F.col("c_nationkey").alias("community"), F.when(k % 2 == 0, "#102030").alias("color"), F.lit(1.0).alias("display_weight"))
    return topics.display_attributes(nodes, ["BUILDING", "7"])


@query("federated_stats", """WITH s AS (SELECT source, count(*) AS records, count(DISTINCT lang) AS documents, max(doc_id) AS modified_at, bool_or(n_chars > 20000) AS truncated, CASE WHEN source = 'src3' THEN 'degraded' ELSE 'ok' END AS status FROM documents GROUP BY 1)
SELECT count(*) AS sources, CAST(sum(records) AS BIGINT) AS records, CAST(sum(documents) AS BIGINT) AS documents, max(modified_at) AS modified_at, bool_or(truncated) AS truncated, CASE WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'ok' END AS status FROM s""")
def federated_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("lang").alias("documents"), F.max("doc_id").alias("modified_at"), F.bool_or(F.col("n_chars") > 20000).alias("truncated")).withColumn("status", F.when(F.col("source") == "src3", "degraded").otherwise("ok"))
    return topics.federated_stats(s)


@query("topic_colors", """WITH t AS (SELECT n_name AS topic, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS turn, 37 + 20 * r_regionkey AS r, 99 + 15 * r_regionkey AS g, 235 - 30 * r_regionkey AS b, CASE WHEN n_nationkey % 7 = 0 THEN '#102030' END AS own FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT *, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo FROM t), y AS (SELECT *, hi - lo AS d, (hi + lo) / 2 AS l FROM x),
h AS (SELECT topic, own, l, d / (1 - abs(2 * l - 1)) * least(l, 1 - l) AS a, (60 * CASE greatest(r, g, b) WHEN r THEN (g - b) / 255.0 / d WHEN g THEN (b - r) / 255.0 / d + 2 ELSE (r - g) / 255.0 / d + 4 END + 360 + 11 * turn) % 360 AS h FROM y),
k AS (SELECT topic, own, l, a, h / 30 AS k0, (8 + h / 30) % 12 AS k8, (4 + h / 30) % 12 AS k4 FROM h)
SELECT topic, coalesce(own, printf('#%02X%02X%02X', CAST(round(255 * (l - a * greatest(-1, least(k0 - 3, 9 - k0, 1)))) AS INTEGER), CAST(round(255 * (l - a * greatest(-1, least(k8 - 3, 9 - k8, 1)))) AS INTEGER), CAST(round(255 * (l - a * greatest(-1, least(k4 - 3, 9 - k4, 1)))) AS INTEGER))) AS color FROM k""")
def topic_colors(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("r_regionkey").cast("int")
    themed = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return topics.topic_colors(themed.select(F.col("n_name").alias("topic"), F.col("r_name").alias("theme"), F.format_string("#%02X%02X%02X", 37 + 20 * k, 99 + 15 * k, 235 - 30 * k).alias("theme_color"), F.when(F.col("n_nationkey") % 7 == 0, "#102030").alias("color")))
