"""Queries over graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import graph, lexical
from tessera.plans.inputs import EDGES_SQL, LINKS_SQL, RECORDS_SQL, edges, links, records
from tessera.plans.registry import query
from tessera.session import table


@query("edge_merge", f"WITH {EDGES_SQL}, doubled AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w * 0.5 FROM edges UNION ALL SELECT src, src, w FROM edges) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM doubled WHERE src <> dst AND w > 0 GROUP BY 1, 2")
def edge_merge(spark, sf_dir):
    e = edges(spark, sf_dir)
    doubled = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") * 0.5).alias("w"))).unionByName(e.select("src", F.col("src").alias("dst"), "w"))
    return graph.merge_edges(doubled, graph.parts(spark, 2 * table(spark, sf_dir, "lineitem").count()))


@query("edge_degree", f"WITH {EDGES_SQL} SELECT node, sum(w) AS degree FROM (SELECT src AS node, w FROM edges UNION ALL SELECT dst, w FROM edges) GROUP BY 1")
def edge_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query("edge_restrict", f"WITH {EDGES_SQL} SELECT src, dst, w FROM edges WHERE src % 3 > 0 AND dst % 3 > 0")
def edge_restrict(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().where("node % 3 > 0")
    return graph.restrict(e, nodes).select("src", "dst", "w")


@query("ring_edges", """WITH m AS (SELECT c_nationkey AS grp, c_custkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
p AS (SELECT m.grp, m.node AS x, o.node AS y, k AS off FROM m, range(1, 4) t(k), m o WHERE m.n > 1 AND k <= m.n - 1 AND o.grp = m.grp AND o.pos = (m.pos + k) % m.n)
SELECT least(x, y) AS src, greatest(x, y) AS dst, round(5.0 / sqrt(arg_min(off, x * 10 + off)), 6) AS w FROM p GROUP BY grp, least(x, y), greatest(x, y)""")
def ring_edges(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("node"))
    return graph.ring_edges(members).withColumn("w", F.round("w", 6))


@query("related_two_hop", f"""WITH {LINKS_SQL}, b AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), h1 AS (SELECT dst AS id FROM b WHERE src = 7),
h AS (SELECT id, 1 AS d FROM h1 UNION ALL SELECT b.dst, 2 FROM h1 JOIN b ON b.src = h1.id) SELECT id, CAST(min(d) AS INTEGER) AS distance FROM h WHERE id <> 7 GROUP BY 1""")
def related_two_hop(spark, sf_dir):
    return lexical.related(links(spark, sf_dir), 7)


@query("cocitation", f"WITH {LINKS_SQL} SELECT x.dst AS seed, y.dst AS id, count(DISTINCT x.src) AS shared FROM links x JOIN links y ON x.src = y.src AND x.dst <> y.dst WHERE x.dst IN (7, 13, 26) GROUP BY 1, 2")
def cocitation(spark, sf_dir):
    return lexical.cocitations(links(spark, sf_dir), [7, 13, 26])


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array((F.col("page_id") % 5).cast("string"), (F.col("page_id") % 7).cast("string")).alias("tags"))


@query("graph_rerank_scores", f"""WITH {LINKS_SQL}, b AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
h AS (SELECT dst AS id, 1.0 AS g FROM b WHERE src = 7 UNION ALL SELECT b.dst, 0.55 FROM b x JOIN b ON b.src = x.dst WHERE x.src = 7),
t AS (SELECT page_id AS id, least(0.45, 0.2 * len(list_intersect([CAST(page_id % 5 AS VARCHAR), CAST(page_id % 7 AS VARCHAR)], ['2', '0']))) AS g FROM pages WHERE page_id <> 7),
c AS (SELECT y.dst AS id, least(0.7, 0.25 * count(DISTINCT x.src)) AS g FROM links x JOIN links y ON x.src = y.src AND y.dst <> 7 WHERE x.dst = 7 GROUP BY 1)
SELECT id, CAST(max(g) AS DOUBLE) AS graph_score FROM (SELECT * FROM h WHERE id <> 7 UNION ALL SELECT * FROM t UNION ALL SELECT * FROM c) WHERE g > 0 GROUP BY 1""")
def graph_rerank_scores(spark, sf_dir):
    return lexical.graph_scores(_nodes(spark, sf_dir), links(spark, sf_dir), [7])


@query("path_counts", f"WITH {RECORDS_SQL} SELECT source_id AS prefix, CAST(1 AS INTEGER) AS depth, count(*) AS documents FROM records GROUP BY 1 UNION ALL SELECT source_id || '/' || hierarchy[2], CAST(2 AS INTEGER), count(*) FROM records GROUP BY 1")
def path_counts(spark, sf_dir):
    return graph.path_counts(records(spark, sf_dir))


@query("project_choice", f"""WITH {RECORDS_SQL}, c1 AS (SELECT source_id, count(*) AS n FROM records GROUP BY 1), c2 AS (SELECT source_id, hierarchy[2] AS lang, count(*) AS n FROM records GROUP BY 1, 2)
SELECT r.id, CASE WHEN c1.n BETWEEN 2 AND 40 THEN r.source_id WHEN c2.n BETWEEN 2 AND 40 THEN r.source_id || '/' || r.hierarchy[2] WHEN c2.n >= 2 THEN r.source_id || '/' || r.hierarchy[2] WHEN c1.n >= 2 THEN r.source_id ELSE r.source_id END AS project
FROM records r JOIN c1 USING (source_id) JOIN c2 ON c2.source_id = r.source_id AND c2.lang = r.hierarchy[2]""")
def project_choice(spark, sf_dir):
    return graph.projects(records(spark, sf_dir), most=40)


_FEATS = """feats AS (SELECT o_custkey AS id, term, max(w) AS w FROM (
  SELECT o_custkey, 'p' || (l_partkey % 400) AS term, 1.5 AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, 'c' || c_nationkey, 4.2 FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2)"""


def _feats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 400).cast("int").alias("part"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.concat(F.lit("p"), F.col("part").cast("string")).alias("term"), F.lit(1.5).alias("w"))
    nations = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("term"), F.lit(4.2).alias("w"))
    rows = parts.unionByName(nations)
    return rows.groupBy(F.col("o_custkey").alias("id"), "term").agg(F.max("w").alias("w"))


@query("tfidf_knn", f"""WITH {_FEATS}, n AS (SELECT count(DISTINCT id) AS n FROM feats), df AS (SELECT term, count(*) AS df FROM feats GROUP BY 1 HAVING count(*) >= 2),
v AS (SELECT id, term, df, w * (ln((n + 1.0) / (df + 1)) + 1) AS v, row_number() OVER (PARTITION BY term ORDER BY id) - 1 AS pos FROM feats JOIN df USING (term), n),
norm AS (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1), u AS (SELECT v.* FROM v, n WHERE df <= greatest(24, round(n * 0.16))),
d AS (SELECT a.id AS a, b.id AS b, 2.0 * a.v * b.v AS d FROM u a JOIN u b ON a.term = b.term AND a.id < b.id WHERE a.df <= 48
  UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), a.v * b.v FROM u a, range(1, 9) t(k), u b WHERE a.df > 48 AND b.term = a.term AND b.pos = (a.pos + k) % a.df),
s AS (SELECT a, b, sum(d) / (any_value(x.norm) * any_value(y.norm)) AS s FROM d JOIN norm x ON x.id = a JOIN norm y ON y.id = b GROUP BY 1, 2 HAVING sum(d) / (any_value(x.norm) * any_value(y.norm)) >= 0.08),
e AS (SELECT a AS x, a, b, s FROM s UNION ALL SELECT b, a, b, s FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, b, a) AS r FROM e)
SELECT a AS src, b AS dst, round(max(s), 6) AS similarity FROM r WHERE r <= 10 GROUP BY 1, 2""")
def tfidf_knn(spark, sf_dir):
    return graph.semantic_edges(_feats(spark, sf_dir)).select("src", "dst", F.round("similarity", 6).alias("similarity"))


_ASSIGN = "assigned AS (SELECT DISTINCT node, CAST(node % 4 AS INTEGER) AS community FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"


def _assigned(e):
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("community", (F.col("node") % 4).cast("int"))


@query("induced_graph", f"WITH {EDGES_SQL} SELECT CAST(least(src % 4, dst % 4) AS INTEGER) AS src, CAST(greatest(src % 4, dst % 4) AS INTEGER) AS dst, sum(w) AS w FROM edges GROUP BY 1, 2")
def induced_graph(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.induced(e, _assigned(e))


_HUBS = "deg AS (SELECT node, sum(w) AS degree FROM (SELECT src AS node, w FROM edges UNION ALL SELECT dst, w FROM edges) GROUP BY 1), hubs AS (SELECT community, arg_min(node, -round(ln(1 + degree), 9) * 1e6 + node * 1e-6) AS hub FROM assigned JOIN deg USING (node) GROUP BY 1)"


def _hubs(e):
    scores = graph.degrees(e).select("node", F.round(F.log1p("degree"), 9).alias("score"))
    return graph.hubs(_assigned(e), scores)


@query("hub_choice", f"WITH {EDGES_SQL}, {_ASSIGN}, {_HUBS} SELECT community, hub FROM hubs")
def hub_choice(spark, sf_dir):
    return _hubs(edges(spark, sf_dir))


@query("representative_hubs", f"""WITH {EDGES_SQL}, {_ASSIGN}, deg AS (SELECT node, sum(w) AS degree FROM (SELECT src AS node, w FROM edges UNION ALL SELECT dst, w FROM edges) GROUP BY 1),
s AS (SELECT node, ln(1 + degree) * (1 + least(0.45, 0.045 * (node % 6 + 1))) * CASE WHEN node % 7 = 0 THEN 0.06 ELSE 1 END * CASE node % 3 WHEN 0 THEN 0.65 + 0.35 * 0.5 WHEN 1 THEN 1.0 ELSE 0.025 END AS score FROM deg)
SELECT community, node AS hub, round(score, 6) AS score FROM assigned JOIN s USING (node) QUALIFY row_number() OVER (PARTITION BY community ORDER BY round(score, 9) DESC, node) = 1""")
def representative_hubs(spark, sf_dir):
    e, n = edges(spark, sf_dir), F.col("node")
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    title = F.array_join(F.slice(F.array(*map(F.lit, words)), F.lit(1), (n % 6 + 1).cast("int")), " ")
    nodes = graph.degrees(e).select("node", title.alias("title"), (n % 7 == 0).alias("navigation"), F.when(n % 3 == 0, 0.5).when(n % 3 == 2, 0.1).alias("display_weight"))
    scores = graph.representative_scores(e, nodes).withColumn("score", F.round("score", 9))
    found = graph.hubs(_assigned(e), scores)
    return found.join(scores.withColumnRenamed("node", "hub"), "hub").select("community", "hub", F.round("score", 6).alias("score"))


def _propagation_sql(steps: int) -> str:
    out = [EDGES_SQL, _ASSIGN, _HUBS, "both_ways AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)", "mean AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM both_ways)", "a0 AS (SELECT node, community, 1.0::DOUBLE AS a FROM assigned)"]
    for k in range(steps):
        out.append(f"s{k} AS (SELECT node, community, sum(a) AS a FROM (SELECT node, community, a * 0.48 AS a FROM a0 UNION ALL SELECT src, community, 0.52 * p * a FROM mean JOIN a{k} ON a{k}.node = dst) GROUP BY 1, 2)")
        out.append(f"n{k} AS (SELECT node, community, a / sum(a) OVER (PARTITION BY node) AS a FROM s{k} UNION ALL SELECT hub, community, 0.72 FROM hubs)")
        out.append(f"a{k + 1} AS (SELECT node, community, sum(a) / sum(sum(a)) OVER (PARTITION BY node) AS a FROM n{k} GROUP BY 1, 2)")
    return "WITH " + ", ".join(out) + f" SELECT node, community, round(a, 6) AS a FROM a{steps} WHERE node NOT IN (SELECT hub FROM hubs) UNION ALL SELECT hub, community, 1.0 FROM hubs"


@query("affinity_propagation", _propagation_sql(4))
def affinity_propagation(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.propagate(e, _assigned(e), _hubs(e)).withColumn("a", F.round("a", 6))


@query("community_summary", f"WITH {EDGES_SQL}, {_ASSIGN}, {_HUBS} SELECT community, count(*) AS size, count(*) FILTER (node % 10 / 10.0 >= 0.2) AS visible, sum(degree) AS degree FROM assigned JOIN deg USING (node) GROUP BY 1")
def community_summary(spark, sf_dir):
    e = edges(spark, sf_dir)
    a = _assigned(e)
    return graph.cluster_summary(a, e, a.select("node", (F.col("node") % 10 / 10.0).alias("display_weight")))


@query("cluster_parents", f"""WITH {EDGES_SQL}, {_ASSIGN}, c AS (SELECT community, count(*) AS size, count(*) FILTER (node % 10 / 10.0 >= 0.2) AS visible FROM assigned GROUP BY 1),
h AS (SELECT community, CASE WHEN node % 5 <= community % 5 THEN 't' || (community % 3) END AS parent, count(*) AS n FROM assigned GROUP BY 1, 2)
SELECT parent, sum(size) AS size, sum(visible) AS visible, array_to_string(list(community ORDER BY community), ',') AS communities FROM h JOIN c USING (community) WHERE parent IS NOT NULL AND n * 2 > size GROUP BY 1""")
def cluster_parents(spark, sf_dir):
    e, n, c = edges(spark, sf_dir), F.col("node"), F.col("community")
    a = _assigned(e)
    summary = graph.cluster_summary(a, e, a.select("node", (n % 10 / 10.0).alias("display_weight")))
    parents = a.select("node", F.when(n % 5 <= c % 5, F.concat(F.lit("t"), (c % 3).cast("string"))).alias("parent"))
    got = graph.cluster_parents(a, parents, summary)
    return got.select("parent", "size", "visible", F.array_join(F.col("communities").cast("array<string>"), ",").alias("communities"))


@query("consolidated_communities", f"""WITH {EDGES_SQL}, assigned AS (SELECT DISTINCT node, CAST(node % 30 AS INTEGER) AS community FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)), {_HUBS},
sized AS (SELECT community, sum(degree) AS score, count(*) AS n FROM assigned JOIN deg USING (node) GROUP BY 1), kept AS (SELECT community, row_number() OVER (ORDER BY score DESC, n DESC, community) - 1 AS final FROM sized WHERE n >= 2 QUALIFY final < 12),
ties AS (SELECT a.community, k.final, sum(w) AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) e JOIN assigned a ON a.node = src JOIN assigned b ON b.node = dst JOIN kept k ON k.community = b.community WHERE a.community <> b.community GROUP BY 1, 2),
tied AS (SELECT community, final FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY w DESC, final) AS r FROM ties) WHERE r = 1)
SELECT node, CAST(coalesce(kept.final, tied.final, -1) AS INTEGER) AS community FROM assigned LEFT JOIN kept USING (community) LEFT JOIN tied USING (community)""")
def consolidated_communities(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.consolidate(e, _assigned(e).withColumn("community", (F.col("node") % 30).cast("int")))


@query("louvain_communities")
def louvain_communities(spark, sf_dir):
    return graph.communities(graph.stored(edges(spark, sf_dir)))


def _labels_sql(rounds: int) -> str:
    out = [EDGES_SQL, "b AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)", "l0 AS (SELECT DISTINCT src AS node, src AS community FROM b)"]
    for k in range(rounds):
        votes = f"SELECT b.src AS node, community, sum(w) AS v FROM b JOIN l{k} ON l{k}.node = b.dst GROUP BY 1, 2 UNION ALL SELECT node, community, 1e-9 FROM l{k}"
        out.append(f"l{k + 1} AS (SELECT node, community FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY v DESC, community) = 1)")
    return "WITH " + ", ".join(out) + f" SELECT node, community FROM l{rounds}"


@query("label_propagation_communities", _labels_sql(4))
def label_propagation_communities(spark, sf_dir):
    return graph.label_propagation(edges(spark, sf_dir), 4)


_THEMES = "SELECT lang AS theme, source AS topic FROM documents"


@query("legend_rollup", f"WITH d AS ({_THEMES}), r AS (SELECT theme, topic, count(*) AS size, grouping(topic) AS g FROM d GROUP BY ROLLUP (theme, topic) HAVING grouping(theme) = 0) SELECT theme, CASE WHEN g = 0 THEN topic END AS topic, size, round(100.0 * size / (SELECT count(*) FROM d), 6) AS percentage FROM r")
def legend_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("theme"), F.col("source").alias("topic"))
    return graph.legend(d).withColumn("percentage", F.round("percentage", 6))


@query("natural_break", """WITH s AS (SELECT c_mktsegment || (c_nationkey % 5) AS key, count(*) AS size, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, key) AS rank, lead(pct) OVER (ORDER BY size DESC, key) AS nxt FROM s), c AS (SELECT arg_min(rank, -round((pct - nxt) / pct, 12) * 1e6 + rank * 1e-6) AS cut FROM r WHERE nxt IS NOT NULL)
SELECT key, size, round(pct, 6) AS percentage, CAST(rank AS INTEGER) AS rank FROM r, c WHERE rank <= cut""")
def natural_break(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy(F.concat("c_mktsegment", (F.col("c_nationkey") % 5).cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("size"))
    total = s.agg(F.sum("size").alias("t"))
    shares = s.crossJoin(F.broadcast(total)).select("key", "size", (F.col("size") * 100.0 / F.col("t")).alias("percentage"))
    return graph.natural_break(shares).withColumn("percentage", F.round("percentage", 6))


@query("graph_features", f"""WITH {RECORDS_SQL}, f AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z][a-z0-9+#.]+')) AS term, 1.5 AS w FROM records UNION ALL SELECT id, unnest(regexp_extract_all(lower(hierarchy[2]), '[a-z][a-z0-9+#.]+')), 4.2 FROM records
  UNION ALL SELECT id, unnest(regexp_extract_all(lower(source_id), '[a-z][a-z0-9+#.]+')), 0.2 FROM records UNION ALL SELECT id, unnest(regexp_extract_all(lower(hierarchy[2]), '[a-z][a-z0-9+#.]+')), 0.55 FROM records)
SELECT id, term, CAST(max(w) AS DOUBLE) AS w FROM f GROUP BY 1, 2""")
def graph_features(spark, sf_dir):
    return graph.features(records(spark, sf_dir).drop("heading"))


@query("exact_canonical_copies", """WITH c AS (SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g'), chr(10) || ' ' || chr(9)) AS c FROM documents), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS first FROM c)
SELECT doc_id, first FROM f WHERE first <> doc_id""")
def exact_canonical_copies(spark, sf_dir):
    from tessera.operators import dedup

    d = table(spark, sf_dir, "documents").select("doc_id", text.canonical_content(F.coalesce("text", F.lit(""))).alias("c"))
    return dedup.duplicates(d, F.sha2("c", 256), [], "doc_id").where("duplicate_of is not null").select(F.col("id").alias("doc_id"), F.col("duplicate_of").alias("first"))
