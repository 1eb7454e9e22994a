"""Queries over the smaller functions and operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ids, numeric, policy, text
from tessera.operators import catalog, channels, graph, lexical, segments, topics
from tessera.plans import search
from tessera.plans.inputs import EDGES_SQL, LINKS_SQL, RECORDS_SQL, edges, links, records
from tessera.plans.registry import query
from tessera.session import table

_NOTES_SQL = "notes AS (SELECT page_id AS id, 'p/' || page_id || '.md' AS path, 'Page ' || page_id AS title, ['t' || (page_id % 3), 'u' || (page_id % 2), 'v' || (page_id % 5)] AS tags FROM pages)"


def _notes(spark, sf_dir):
    i = F.col("page_id")
    text_of = lambda c: c.cast("string")
    tags = F.array(*[F.concat(F.lit(h), text_of(i % m)) for h, m in (("t", 3), ("u", 2), ("v", 5))])
    return table(spark, sf_dir, "pages").select(i.alias("id"), F.concat(F.lit("p/"), text_of(i), F.lit(".md")).alias("path"), F.concat(F.lit("Page "), text_of(i)).alias("title"), tags.alias("tags"))


_PATHS_SQL = f"""{LINKS_SQL}, b AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
one AS (SELECT DISTINCT dst AS id FROM b WHERE src = 13 AND dst <> 13),
two AS (SELECT b.dst AS id, min(one.id) AS via FROM one JOIN b ON b.src = one.id WHERE b.dst <> 13 AND b.dst NOT IN (SELECT id FROM one) GROUP BY 1),
routes AS (SELECT id, 1 AS distance, '13>' || id AS route FROM one UNION ALL SELECT id, 2, '13>' || via || '>' || id FROM two)"""


@query("shortest_paths", f"WITH {_PATHS_SQL} SELECT id, distance, route FROM routes")
def shortest_paths(spark, sf_dir):
    found = lexical.shortest_paths(links(spark, sf_dir), 13)
    return found.select("id", "distance", F.array_join(F.col("route").cast("array<string>"), ">").alias("route"))


@query("related_notes", f"""WITH {_PATHS_SQL}, {_NOTES_SQL}, own AS (SELECT tags AS own FROM notes WHERE id = 13),
told AS (SELECT notes.id, path, title, distance, route, CASE distance WHEN 1 THEN 'directly linked' ELSE 'connected through one note' END AS r, list_filter(own, lambda t: list_contains(tags, t)) AS shared FROM routes JOIN notes USING (id), own)
SELECT id, path, title, distance, route, r || CASE WHEN len(shared) > 0 THEN '; shared tags: ' || array_to_string(shared[1:3], ', ') ELSE '' END AS reasons FROM told ORDER BY distance, path LIMIT 30""")
def related_notes(spark, sf_dir):
    found = lexical.related_notes(_notes(spark, sf_dir), links(spark, sf_dir), 13, limit=30)
    return found.withColumn("route", F.array_join(F.col("route").cast("array<string>"), ">")).withColumn("reasons", F.array_join("reasons", "; "))


#: Folders and names that documents are given in turn.
_SHAPES = ["Docs/{}.md", "a/ｔｅｓｔｓ/{}.md", "a/testing/{}.md", "x/HISTORY.md", "x/todo.md", "x/todos.md.md", "issue-archive/{}.md", "b/.github/{}.md", "bxgithub/{}.md", "knowledge/{}.md", "c/knowledgebase/{}.md", "d/history/{}.md", "e/{}.md"]


@query("supporting_artifacts", """WITH s AS (SELECT doc_id, replace(['Docs/{}.md', 'a/ｔｅｓｔｓ/{}.md', 'a/testing/{}.md', 'x/HISTORY.md', 'x/todo.md', 'x/todos.md.md', 'issue-archive/{}.md', 'b/.github/{}.md', 'bxgithub/{}.md', 'knowledge/{}.md', 'c/knowledgebase/{}.md', 'd/history/{}.md', 'e/{}.md'][doc_id % 13 + 1], '{}', CAST(doc_id AS VARCHAR)) AS path FROM documents)
SELECT doc_id, path, doc_id % 17 = 0 OR list_has_any(string_split(replace(lower(path), 'ｔｅｓｔｓ', 'tests'), '/'), ['docs', 'tests', 'issue-archive', '.github', 'knowledge']) OR path LIKE '%/HISTORY.md' OR path LIKE '%/todo.md' AS supporting FROM s""")
def supporting_artifacts(spark, sf_dir):
    i = F.col("doc_id")
    path = F.replace(F.element_at(F.array(*map(F.lit, _SHAPES)), (i % 13 + 1).cast("int")), F.lit("{}"), i.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("supporting", policy.is_supporting(F.col("path"), i % 17 == 0))


@query("record_search_text", f"WITH {RECORDS_SQL} SELECT id, md5(title || chr(10) || chr(10) || array_to_string(tags, chr(10)) || chr(10) || array_to_string(hierarchy, chr(10)) || chr(10) || content) AS text_md5 FROM records")
def record_search_text(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("id", F.md5(channels.search_text(r)).alias("text_md5"))


@query("dense_gated", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), q AS (SELECT x AS q FROM v WHERE id = 0)
SELECT id, round(list_cosine_similarity(x, q), 6) AS score FROM v, q WHERE list_cosine_similarity(x, q) >= 0.18 AND label % 4 IN (1, 2)""")
def dense_gated(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    words = e.select(F.col("vec_id").alias("id"), F.array(F.concat(F.lit("w"), (F.col("label") % 4).cast("string")), F.lit("x")).alias("tokens"))
    found = channels.dense(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")), list(first[0]), words=words, terms=["w1", "w2", "none"])
    return found.select("id", F.round("score", 6).alias("score"))


@query("bundle_statistics", """SELECT count(*) FILTER (WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AND o_orderpriority <> '5-LOW') AS active_documents, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS tombstones, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS duplicates, 3 AS lexical_segments FROM orders""")
def bundle_statistics(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.col("o_orderdate")).alias("tombstone_at"), F.when(k % 5 == 0, "x").alias("duplicate_of"), F.when(F.col("o_orderpriority") == "5-LOW", "never").otherwise("default").alias("retrieval_scope"))
    return catalog.bundle_statistics(rows, 3)


@query("reused_units", """SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 > 0 AS reused FROM documents""")
def reused_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path, content = F.concat(F.lit("n/"), F.col("doc_id").cast("string")), F.sha2(F.coalesce("text", F.lit("")), 256)
    scanned = d.select("doc_id", path.alias("path"), content.alias("content_sha256"))
    before = scanned.where("doc_id % 2 = 0").withColumn("content_sha256", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("content_sha256")))
    todo, kept = catalog.reusable(scanned, before, True)
    return todo.select("doc_id", F.lit(False).alias("reused")).unionByName(kept.select("doc_id", F.lit(True).alias("reused")))


@query("normalized_documents", """WITH d AS (SELECT c_custkey AS id, 'c/' || c_name || '.md' AS path, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS title, ['#' || c_mktsegment, 'x'] AS tags, list_transform(range(c_nationkey), lambda i: 'h' || i) AS headings FROM customer WHERE c_custkey % 3 > 0)
SELECT c_custkey AS id, coalesce(path, CAST(c_custkey AS VARCHAR)) AS path, CASE WHEN d.id IS NULL THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS title, coalesce(array_to_string(list_transform(tags, lambda t: ltrim(t, '#')), ','), '') AS tags, coalesce(len(headings[1:16]), 0) AS headings FROM customer LEFT JOIN d ON d.id = c_custkey""")
def normalized_documents(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    numbers = F.transform(F.when(F.col("c_nationkey") > 0, F.sequence(F.lit(0), F.col("c_nationkey") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("h"), i.cast("string")))
    raw = c.where(k % 3 > 0).select(k.alias("id"), F.concat(F.lit("c/"), "c_name", F.lit(".md")).alias("path"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("title"), F.lit(None).cast("array<string>").alias("aliases"), F.array(F.concat(F.lit("#"), "c_mktsegment"), F.lit("x")).alias("tags"), numbers.alias("headings"), F.lit(None).cast("string").alias("content"))
    out = catalog.normalized_documents(raw, c.select(k.alias("node")))
    return out.select("id", "path", "title", F.array_join("tags", ",").alias("tags"), F.size("headings").alias("headings"))


@query("overview", """WITH n AS (SELECT o_orderkey % 6 = 0 AS hidden, o_orderpriority AS corpus, o_orderstatus AS scope, o_orderkey % 4 = 0 AS dup, o_custkey % 9 AS chunks, CASE o_orderkey % 12 WHEN 0 THEN 'generated type' ELSE 'empty body' END AS reason FROM orders)
SELECT 'notes' AS kind, 'discovered' AS value, CAST(count(*) AS BIGINT) AS n FROM n UNION ALL SELECT 'notes', CASE WHEN hidden THEN 'excluded' ELSE 'indexed' END, count(*) FROM n GROUP BY 2 UNION ALL SELECT 'notes', 'duplicate', count(*) FROM n WHERE dup HAVING count(*) > 0
UNION ALL SELECT 'notes', 'chunks', CAST(sum(chunks) AS BIGINT) FROM n WHERE NOT hidden UNION ALL SELECT 'corpus', corpus, count(*) FROM n WHERE NOT hidden GROUP BY 2 UNION ALL SELECT 'scope', scope, count(*) FROM n WHERE NOT hidden GROUP BY 2 UNION ALL SELECT 'excluded', reason, count(*) FROM n WHERE hidden GROUP BY 2""")
def overview(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus"), F.when(k % 6 == 0, "never").otherwise(F.col("o_orderstatus")).alias("retrieval_scope"), F.when(k % 12 == 0, F.concat(F.lit("generated type: "), "o_orderpriority")).otherwise("empty body").alias("reason"), (k % 4 == 0).alias("duplicate"), (F.col("o_custkey") % 9).alias("chunks"))
    return catalog.overview(rows)


@query("legend_order", """WITH t AS (SELECT lang AS key, upper(lang) AS label, count(*) AS size FROM documents GROUP BY 1, 2), p AS (SELECT lang || '/' || source AS key, lang AS parent, source AS label, count(*) AS size FROM documents GROUP BY 1, 2, 3)
SELECT p.parent AS theme, p.key AS topic, p.size, CAST(row_number() OVER (ORDER BY t.size DESC, t.label, p.size DESC, p.label) AS INTEGER) AS place FROM p JOIN t ON t.key = p.parent""")
def legend_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    themes = d.groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("size")).withColumn("label", F.upper("key"))
    rows = d.groupBy(F.col("lang").alias("parent"), F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("size")).withColumn("key", F.concat("parent", F.lit("/"), "label"))
    return topics.legend_order(themes, rows)


@query("theme_lookup", """WITH themes AS (SELECT 'r' || r_regionkey AS key, r_name AS label FROM region), topics AS (SELECT 'n-' || n_nationkey AS key, n_name AS label, 'r' || n_regionkey AS theme FROM nation),
asked AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'r' || (c_nationkey % 7) WHEN 1 THEN n_name WHEN 2 THEN lower(r_name) WHEN 3 THEN 'N_' || c_nationkey WHEN 4 THEN ' ' || r_name || ' ' ELSE 'nothing' END AS value FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
v AS (SELECT id, trim(value) AS v, trim(regexp_replace(lower(regexp_replace(trim(value), '[-_]+', ' ', 'g')), '\\s+', ' ', 'g')) AS n FROM asked)
SELECT v.id, coalesce((SELECT min(key) FROM themes WHERE key = v), (SELECT min(key) FROM themes WHERE label = v), (SELECT min(key) FROM themes WHERE translate(lower(key), '-_', '  ') = n OR translate(lower(label), '-_', '  ') = n), (SELECT min(theme) FROM topics WHERE translate(lower(key), '-_', '  ') = n OR translate(lower(label), '-_', '  ') = n)) AS theme FROM v""".replace("\\\\", "\\"))
def theme_lookup(spark, sf_dir):
    region, nation, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    themes = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("label"))
    rows = nation.select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("label"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("theme"))
    both, m = c.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey")), F.col("c_custkey") % 6
    number = F.col("c_nationkey")
    value = F.when(m == 0, F.concat(F.lit("r"), (number % 7).cast("string"))).when(m == 1, F.col("n_name")).when(m == 2, F.lower("r_name")).when(m == 3, F.concat(F.lit("N_"), number.cast("string"))).when(m == 4, F.concat(F.lit(" "), "r_name", F.lit(" "))).otherwise("nothing")
    return topics.resolve_themes(both.select(F.col("c_custkey").alias("id"), value.alias("value")), themes, rows)


@query("source_identities", """WITH s AS (SELECT c_custkey AS id, replace(replace(c_name, '#', '-'), ' ', '') AS n FROM customer)
SELECT id, CASE id % 8 WHEN 0 THEN 'win32:c:/users/' || lower(n) WHEN 1 THEN 'win32-unc://host/share/' || lower(n) WHEN 2 THEN 'posix:/srv/' || n WHEN 3 THEN 'uri:https://ex.org/' || n WHEN 4 THEN 'logical:notes/' || n WHEN 5 THEN 'win32-unc://host/' || lower(n) WHEN 6 THEN 'posix:/' WHEN 7 THEN 'win32:d:/' END AS identity FROM s""")
def source_identities(spark, sf_dir):
    name, i = F.replace(F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" "), F.lit("")), F.col("c_custkey")
    shape = F.array(*map(F.lit, ["C:\\Users\\.\\{}", "\\\\Host\\Share\\x\\..\\{}", "/srv//a/../{}/", "HTTPS://Ex.Org/{}", " notes/./{}", "\\\\?\\UNC\\HOST\\{}", "//?//..", "D:\\.."]))
    raw = F.replace(F.element_at(shape, (i % 8 + 1).cast("int")), F.lit("{}"), name)
    return table(spark, sf_dir, "customer").select(i.alias("id"), ids.source_identity(F.when(i % 8 == 6, F.lit("/..")).otherwise(raw)).alias("identity"))


@query("iso_timestamps", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS told FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def iso_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    told = ids.iso_text(F.col("ts"))
    raw = F.when(F.col("event_id") % 3 == 0, told).when(F.col("event_id") % 3 == 1, F.replace(told, F.lit(".000Z"), F.lit("Z"))).otherwise(F.replace(told, F.lit("T"), F.lit(" ")))
    return e.select("event_id", ids.iso_timestamp(raw).cast("timestamp_ntz").alias("parsed"), told.alias("told"))


@query("federated_matches", """WITH m AS (SELECT 's' || (l_linenumber % 3) AS source_id, l_orderkey AS id, 'd/' || (l_partkey % 50) AS path, round(l_quantity, 0) AS score, (l_orderkey % 4) / 4.0 AS graph_score, CAST(l_suppkey % 5 AS INTEGER) AS confidence, CAST(l_linenumber AS VARCHAR) AS span_id FROM lineitem)
SELECT source_id, id, path, span_id FROM m ORDER BY score * (1 + 0.12 * graph_score) DESC, confidence DESC, score DESC, graph_score DESC, source_id, path, span_id, id LIMIT 50""")
def federated_matches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_linenumber") % 3).alias("s"), F.col("l_orderkey").alias("id"), F.concat(F.lit("d/"), (F.col("l_partkey") % 50).cast("string")).alias("path"), F.round("l_quantity", 0).alias("score"), ((F.col("l_orderkey") % 4) / 4.0).alias("graph_score"), (F.col("l_suppkey") % 5).cast("int").alias("confidence"), F.col("l_linenumber").cast("string").alias("span_id"))
    best, failed = search.federate({f"s{k}": rows.where(F.col("s") == k).drop("s") for k in range(3)}, 50)
    return best.select("source_id", "id", "path", "span_id")


@query("merged_segments", """WITH old AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem),
one AS (SELECT k, n, q * 2 AS q FROM old WHERE k % 7 = 0), two AS (SELECT k, n, q + 1 AS q FROM old WHERE k % 11 = 0 AND k % 3 > 0)
SELECT k, n, q FROM old WHERE k % 7 > 0 AND k % 11 > 0 UNION ALL SELECT k, n, q FROM one WHERE k % 11 > 0 UNION ALL SELECT k, n, q FROM two""")
def merged_segments(spark, sf_dir):
    """Orders kept as a base and two deltas: the first changes some, the second changes some and removes others."""
    k, q = F.col("k"), F.col("q")
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    keys = old.select("k").distinct()
    one, two = old.where(k % 7 == 0).withColumn("q", q * 2), old.where((k % 11 == 0) & (k % 3 > 0)).withColumn("q", q + 1)
    return segments.merged([(old, None), (one, keys.where(k % 7 == 0)), (two, keys.where(k % 11 == 0))], "k")


_PROJECT_SQL = """nodes AS (SELECT DISTINCT node, CASE WHEN node % 11 = 0 THEN NULL WHEN node % 13 = 0 THEN '@root:' || node WHEN node < 40 THEN '@topic:pm-skills:a' WHEN node % 4 = 0 THEN '@knowledge:k' || (node % 28) ELSE 'p' || (node % 30) END AS project, CASE WHEN node % 5 = 0 THEN 0.2 ELSE 1.0 END AS weight FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"""


def _in_order(name: str, items: str, votes: str, near: str) -> list[str]:
    """CTEs that end in ``name`` (item, community): items (item, i from 1) choose one after the other.

    ``votes`` has (item, community, w), ``near`` (item, other, w). The state of the recursion is the list of choices.
    """
    return [
        f"{name}_v AS (SELECT item, list({{c: community, w: w}}) AS v FROM ({votes}) GROUP BY 1)",
        f"{name}_n AS (SELECT x.item, list({{j: o.i, w: x.w}}) AS n FROM ({near}) x JOIN {items} o ON o.item = x.other JOIN {items} m ON m.item = x.item WHERE o.i < m.i GROUP BY 1)",
        f"{name}_t AS (SELECT i, coalesce(v, []) AS v, coalesce(n, []) AS n FROM {items} LEFT JOIN {name}_v USING (item) LEFT JOIN {name}_n USING (item))",
        f"""{name}_s(i, done) AS (SELECT 0::BIGINT, []::INTEGER[] UNION ALL SELECT i, list_append(done, CASE WHEN list_max(s) > 0 THEN CAST(list_position(s, list_max(s)) - 1 AS INTEGER) ELSE -1 END) FROM (
          SELECT t.i, done, list_transform(range(12), lambda c: coalesce(list_sum(list_transform(list_filter(t.v, lambda x: x.c = c), lambda x: x.w)), 0) + coalesce(list_sum(list_transform(list_filter(t.n, lambda x: done[x.j] = c), lambda x: x.w)), 0)) AS s
          FROM {name}_s r JOIN {name}_t t ON t.i = r.i + 1))""",
        f"{name} AS (SELECT item, nullif(done[{items}.i], -1) AS community FROM {items}, (SELECT done FROM {name}_s ORDER BY i DESC LIMIT 1))",
    ]


def _project_sql() -> str:
    out = [EDGES_SQL, _PROJECT_SQL, "b AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)", "g AS (SELECT * FROM nodes WHERE project IS NOT NULL AND NOT starts_with(project, '@root:'))"]
    out.append("z AS (SELECT project, sum(weight) AS eff, sum(coalesce(deg, 0)) AS score, count(*) AS n FROM g LEFT JOIN (SELECT src AS node, sum(w) AS deg FROM b GROUP BY 1) USING (node) GROUP BY 1 HAVING count(*) >= 2)")
    out.append("k AS (SELECT *, CASE WHEN starts_with(project, '@topic:pm-') THEN 0 WHEN starts_with(project, '@knowledge:') THEN 1 ELSE 2 END AS kind FROM z)")
    out.append("r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY eff DESC, score DESC, n DESC, project) AS i FROM k)")
    out.append("c AS (SELECT project, CAST(row_number() OVER (ORDER BY CASE WHEN kind = 0 THEN 0 WHEN kind = 1 AND i <= 4 THEN 1 ELSE 2 END, eff DESC, score DESC, n DESC, project) - 1 AS INTEGER) AS community FROM r QUALIFY community < 12)")
    out.append("h AS (SELECT node, project, community FROM nodes LEFT JOIN c USING (project))")
    out.append("gi AS (SELECT project AS item, row_number() OVER (ORDER BY eff DESC, score DESC, n DESC, project) AS i FROM z WHERE project NOT IN (SELECT project FROM c))")
    ends = "SELECT s.project AS item, d.project AS other, d.community, b.w FROM b JOIN h s ON s.node = b.src JOIN h d ON d.node = b.dst WHERE s.project IN (SELECT item FROM gi)"
    out += _in_order("gj", "gi", f"SELECT item, community, sum(w) AS w FROM ({ends}) WHERE community IS NOT NULL GROUP BY 1, 2", f"SELECT item, other, sum(w) AS w FROM ({ends}) WHERE community IS NULL AND item <> other GROUP BY 1, 2")
    out.append("a AS (SELECT h.node, coalesce(h.community, gj.community) AS community FROM h LEFT JOIN gj ON gj.item = h.project)")
    out.append("ni AS (SELECT node AS item, row_number() OVER (ORDER BY node) AS i FROM a WHERE community IS NULL)")
    ties = "SELECT b.src AS item, b.dst AS other, community, sum(w) AS w FROM b JOIN a ON a.node = b.dst WHERE src <> dst AND src IN (SELECT item FROM ni) GROUP BY 1, 2, 3"
    out += _in_order("nj", "ni", f"SELECT item, community, sum(w) AS w FROM ({ties}) WHERE community IS NOT NULL GROUP BY 1, 2", f"SELECT item, other, w FROM ({ties}) WHERE community IS NULL")
    return "WITH RECURSIVE " + ", ".join(out) + " SELECT a.node, coalesce(a.community, nj.community, -1) AS community FROM a LEFT JOIN nj ON nj.item = a.node"


def _project_nodes(e):
    n = F.col("node")
    name = F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.concat(F.lit("@root:"), n.cast("string"))).when(n < 40, "@topic:pm-skills:a").when(n % 4 == 0, F.concat(F.lit("@knowledge:k"), (n % 28).cast("string"))).otherwise(F.concat(F.lit("p"), (n % 30).cast("string")))
    return graph.degrees(e).select("node", name.alias("project"), F.when(n % 5 == 0, 0.2).otherwise(1.0).alias("weight"))


@query("project_communities", _project_sql())
def project_communities(spark, sf_dir):
    e = graph.stored(edges(spark, sf_dir))
    return graph.consolidate_projects(e, _project_nodes(e))


_LINEAR = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_BACK = "CAST(round(255 * CASE WHEN {0} <= 0.0031308 THEN 12.92 * {0} ELSE 1.055 * pow({0}, 1 / 2.4) - 0.055 END) AS INTEGER)"


def _color_sql() -> str:
    lin, back = _LINEAR.format, _BACK.format
    mixed = ", ".join(f"sum(a * {lin(c)}) / sum(a) AS {c}" for c in "rgb")
    rounded = ", ".join(f"{back(c)} AS {c}" for c in "rgb")
    faded = ", ".join(f"(1 - dim) * {lin(f'm.{c}')} + dim * {lin(str(v))} AS {c}" for c, v in zip("rgb", (139, 146, 161)))
    return f"""WITH {EDGES_SQL}, b AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges), deg AS (SELECT src AS node, sum(w) AS deg FROM b GROUP BY 1), top AS (SELECT greatest(1.0, max(deg)) AS top FROM deg),
n AS (SELECT node, CASE WHEN node % 9 = 0 THEN '#ABCDEF' END AS color, CASE WHEN node IN (1, 2, 3) THEN node END AS hub, CASE WHEN node % 3 = 0 THEN 0.3 END AS weight FROM deg),
aff AS (SELECT node, k AS community, (1 + (node * k) % 7) / 10.0 AS a FROM deg, (VALUES (1), (2), (3)) v(k) WHERE node % 8 > 0), col AS (SELECT * FROM (VALUES (1, 200, 30, 60), (2, 10, 180, 90), (3, 40, 80, 220)) v(community, r, g, b)),
x AS (SELECT node, max(a) / sum(a) AS sure, {mixed} FROM aff JOIN col USING (community) GROUP BY 1), m AS (SELECT node, sure, {rounded} FROM x),
f AS (SELECT n.node, n.color, n.hub, m.r, m.g, m.b, least(0.72, greatest(0.0, 0.18 * (1 - ln(1 + deg) / ln(1 + top)) * (0.65 + 0.35 * (1 - sure)) + (1 - coalesce(weight, 1.0)) * 0.06)) AS dim FROM n JOIN deg USING (node) LEFT JOIN m USING (node), top),
l AS (SELECT m.node, m.color, m.hub, m.r IS NULL AS bare, {faded} FROM f m)
SELECT l.node, CASE WHEN l.color IS NOT NULL THEN '#abcdef' WHEN bare THEN '#8b92a1' WHEN hub IS NOT NULL THEN printf('#%02x%02x%02x', col.r, col.g, col.b) ELSE printf('#%02x%02x%02x', {back('l.r')}, {back('l.g')}, {back('l.b')}) END AS color FROM l LEFT JOIN col ON col.community = hub"""


@query("node_colors", _color_sql())
def node_colors(spark, sf_dir):
    e, n = edges(spark, sf_dir), F.col("node")
    nodes = graph.degrees(e).select("node")
    affinity = nodes.where(n % 8 > 0).select("node", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("community")).withColumn("a", (1 + (n * F.col("community")) % 7) / 10.0)
    colors = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("community", "r", "g", "b"), row)]) for row in ((1, 200, 30, 60), (2, 10, 180, 90), (3, 40, 80, 220))])))
    facts = nodes.select("node", F.when(n % 9 == 0, "#ABCDEF").alias("color"), F.when(n.isin(1, 2, 3), n.cast("int")).alias("hub"), F.when(n % 3 == 0, 0.3).alias("display_weight"))
    return graph.colorize(e, affinity, colors, facts)


@query("marker_features", """WITH a AS (SELECT c_custkey AS id, lower(c_mktsegment) AS s, c_nationkey AS n FROM customer),
t AS (SELECT id, '@context:project' AS term, 4.5 AS w FROM a UNION ALL SELECT id, '@topic:t' || (n % 5), 5.2 FROM a UNION ALL SELECT id, '@topic:product-management', 2.2 FROM a WHERE n % 2 = 0 UNION ALL SELECT id, 'theme' || (n % 3), 2.4 FROM a WHERE n % 3 > 0
  UNION ALL SELECT id, '@priority:' || k, 4.0 FROM a, (VALUES ('build'), ('auto'), ('mac')) v(k) WHERE contains(s, k)) SELECT id, term, CAST(w AS DOUBLE) AS w FROM t""")
def marker_features(spark, sf_dir):
    n = F.col("c_nationkey")
    own = F.array(F.concat(F.lit("t"), (n % 5).cast("string")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("project")).alias("contexts"), F.when(n % 2 == 0, F.concat(own, F.array(F.lit("product-management")))).otherwise(own).alias("topics"), F.when(n % 3 > 0, F.concat(F.lit("theme"), (n % 3).cast("string"))).alias("parent"), F.lower("c_mktsegment").alias("searchable"))
    return graph.marker_features(rows, ["Build", "auto", "mac"])


@query("text_labels", """WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, lower(l_returnflag) || '_b--c ' || l_partkey || '.MD' AS name, 'x\\y/' || l_suppkey || '/' || l_partkey || '.md' AS path, 'A, b;' || l_linestatus || '; a' || chr(10) || ' ' || l_suppkey AS words FROM lineitem)
SELECT id, trim(regexp_replace(replace(name, '.MD', ''), '[-_ ]+', ' ', 'g')) AS label, split_part(path, '/', 3) AS base, split_part(path, '/', 2) || ' / ' || replace(split_part(path, '/', 3), '.md', '') AS qualified,
  array_to_string(list_distinct_ordered, '|') AS keywords, 'app://open?vault=my%20v&file=' || replace(replace(replace(path, '\\', '%5C'), '/', '%2F'), ' ', '%20') AS uri, sha256(upper(name)) AS body
FROM (SELECT *, list_filter(list_transform(string_split_regex(words, '[,;\\n]'), lambda w: trim(lower(w))), lambda w, i: w <> '' AND list_position(list_transform(string_split_regex(words, '[,;\\n]'), lambda v: trim(lower(v))), w) = i) AS list_distinct_ordered FROM d)""")
def text_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text_of = lambda c: F.col(c).cast("string")
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lower("l_returnflag"), F.lit("_b--c "), text_of("l_partkey"), F.lit(".MD")).alias("name"),
        F.concat(F.lit("x\\y/"), text_of("l_suppkey"), F.lit("/"), text_of("l_partkey"), F.lit(".md")).alias("path"), F.concat(F.lit("A, b;"), "l_linestatus", F.lit("; a\n "), text_of("l_suppkey")).alias("words"),
    )
    return rows.select(
        "id", text.humanize(F.col("name")).alias("label"), text.basename(F.replace("path", F.lit("\\"), F.lit("-"))).alias("base"), text.qualified_name(F.col("path")).alias("qualified"),
        F.array_join(text.keywords(F.col("words")), "|").alias("keywords"), text.open_uri("app", F.lit("my v"), F.col("path")).alias("uri"), ids.body_hash(F.upper("name")).alias("body"),
    )


@query("vector_checks", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN CAST(embedding AS DOUBLE[])[1:10] WHEN vec_id % 7 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: 'NaN'::DOUBLE) WHEN vec_id % 11 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.0) ELSE CAST(embedding AS DOUBLE[]) END AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n, list_sum(list_transform(x, lambda y: abs(y))) AS s FROM v WHERE vec_id % 7 > 0 OR vec_id % 5 = 0)
SELECT v.vec_id, len(v.x) = 64 AND NOT isnan(v.x[1]) AND list_dot_product(v.x, v.x) <= 1.5 AS safe, round(CASE WHEN n > 0 THEN list_sum(list_transform(n.x, lambda y: y / n)) ELSE list_sum(n.x) END, 5) AS unit_sum, round(CASE WHEN s > 0 THEN abs(n.x[1]) / s ELSE abs(n.x[1]) END, 6) AS share, CASE WHEN n.x IS NOT NULL THEN least(0.1, greatest(-0.1, n.x[2])) END AS clamped FROM v LEFT JOIN n USING (vec_id)""")
def vector_checks(spark, sf_dir):
    i, x = F.col("vec_id"), F.col("embedding").cast("array<double>")
    v = F.when(i % 5 == 0, F.slice(x, 1, 10)).when(i % 7 == 0, F.transform(x, lambda _: F.lit(float("nan")))).when(i % 11 == 0, F.transform(x, lambda _: F.lit(0.0))).otherwise(x)
    good = (i % 7 > 0) | (i % 5 == 0)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("x"))
    summed = F.aggregate(numeric.unit(F.col("x")), F.lit(0.0), lambda a, y: a + y)
    share = F.element_at(numeric.shares(F.transform("x", lambda y: F.abs(y))), 1)
    return rows.select("vec_id", numeric.safe_vector(F.col("x"), 64, 1.5).alias("safe"), F.when(good, F.round(summed, 5)).alias("unit_sum"), F.when(good, F.round(share, 6)).alias("share"), F.when(good, numeric.clamp(F.element_at("x", 2), -0.1, 0.1)).alias("clamped"))


_NOTE = "---\ntitle: 'Note {i}'\naliases: [n{i}, note-{m}]\ntags:\n  - kind/{m}\nstatus: draft # said\n---\nintro #inline{m} text\n# Top {i}\nsee [[Page {m}|label]] and [x](b/c{m}.md#h)\n```\n# no heading\n```\n## Sub {m} ##\nend"


@query("parsed_notes", """WITH n AS (SELECT c_custkey AS i, c_custkey % 5 AS m FROM customer)
SELECT i AS id, 'Note ' || i AS title, 'n' || i || ',note-' || m AS aliases, 'inline' || m || ',kind/' || m AS tags, 'Top ' || i || '@1:8|Sub ' || m || '@2:13' AS headings, 7 AS body_start, 'draft' AS status, 'Page ' || m || ',b/c' || m || '.md' AS links, FALSE AS parse_error FROM n""")
def parsed_notes(spark, sf_dir):
    from tessera.sources import markdown

    i = F.col("c_custkey")
    content = F.replace(F.replace(F.lit(_NOTE), F.lit("{i}"), i.cast("string")), F.lit("{m}"), (i % 5).cast("string"))
    notes = table(spark, sf_dir, "customer").select(i.alias("id"), F.concat(F.lit("n/"), i.cast("string"), F.lit(".md")).alias("path"), content.alias("content"))
    found = markdown.parse_notes(notes, compiled=True)
    told = F.transform("headings", lambda h: F.concat(h["text"], F.lit("@"), h["level"].cast("string"), F.lit(":"), h["line"].cast("string")))
    return found.select(
        "id", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join("tags", ",").alias("tags"), F.array_join(told, "|").alias("headings"), "body_start",
        F.element_at("fields", "status")[0].alias("status"), F.array_join(markdown.links(F.col("content")), ",").alias("links"), "parse_error",
    )


@query("resolved_links", """WITH n AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE '' END || 'S' || s_suppkey || '.md' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE '' END AS folder FROM supplier),
r AS (SELECT s_suppkey AS src, s_suppkey + 1 AS t, s_suppkey % 4 AS way FROM supplier)
SELECT DISTINCT src, t AS dst FROM r JOIN n ON n.id = t JOIN n own ON own.id = src WHERE way IN (0, 1) OR (way = 2 AND own.folder = n.folder) OR (way = 3 AND (n.folder = 'a/' AND own.folder = '' OR n.folder = 'a/'))""")
def resolved_links(spark, sf_dir):
    i = F.col("s_suppkey")
    folder = lambda k: F.when(k % 3 == 0, "a/").when(k % 3 == 1, "b/").otherwise("")
    s = table(spark, sf_dir, "supplier").select(i)
    notes = s.select(i.alias("id"), F.concat(folder(i), F.lit("S"), i.cast("string"), F.lit(".md")).alias("path"))
    name = F.concat(F.lit("s"), (i + 1).cast("string"))
    # by name, by name with extension, next to the note, and by a path from the root
    target = F.when(i % 4 == 0, name).when(i % 4 == 1, F.concat(name, F.lit(".MD"))).when(i % 4 == 2, F.concat(F.lit("./"), F.when(folder(i) == folder(i + 1), name).otherwise("missing"))).otherwise(F.concat(F.lit("A/"), F.when((i + 1) % 3 == 0, name).otherwise("missing")))
    return lexical.resolve_links(notes, s.select(i.alias("src"), target.alias("target")))


@query("truncated_texts", r"""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 50 THEN text ELSE regexp_replace(left(text, list_max(list_filter(range(0, 51), lambda k: octet_length(encode(left(text, k))) <= 50))), '\s+$', '') END AS text FROM documents""")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_bytes(F.col("text"), 50).alias("text"))


@query("reweighted_edges", f"WITH {EDGES_SQL} SELECT src, dst, w * CASE WHEN src % 2 = 0 THEN 0.5 ELSE 0 END AS w FROM edges WHERE src % 2 = 0")
def reweighted_edges(spark, sf_dir):
    return graph.reweight(edges(spark, sf_dir), F.col("w") * F.when(F.col("src") % 2 == 0, 0.5).otherwise(0.0))


@query("rolled_postings", "SELECT l_orderkey AS id, l_shipdate::DATE::VARCHAR AS term, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS tf FROM lineitem GROUP BY 1, 2")
def rolled_postings(spark, sf_dir):
    from tessera.operators import postings

    li = table(spark, sf_dir, "lineitem")
    return postings.roll_up(li.select(F.col("l_orderkey").alias("id"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("term"), F.col("l_quantity").cast("int").alias("tf")), "id")


@query("generation_faults", """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 = 0 AS dead, c_custkey % 10 > 0 AS doc FROM customer)
SELECT * FROM (SELECT 'duplicate ordinal' AS "check", count(*) AS n FROM (SELECT k // 2 FROM c WHERE k < 4 GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'active entry without document', count(*) FILTER (WHERE NOT dead AND NOT doc AND k >= 4) FROM c UNION ALL SELECT 'document without active entry', count(*) FILTER (WHERE dead AND doc AND k >= 4) FROM c
UNION ALL SELECT 'content differs', count(*) FILTER (WHERE NOT dead AND doc AND k >= 4 AND k % 7 = 0) FROM c UNION ALL SELECT 'chunk without document', count(*) FROM orders JOIN c ON k = o_custkey WHERE NOT doc AND k >= 4
UNION ALL SELECT 'temporal differs', count(*) FILTER (WHERE NOT doc AND k >= 4) FROM c UNION ALL SELECT 'posting without document', count(*) FILTER (WHERE NOT doc AND k >= 4 AND k % 4 = 0) FROM c) WHERE n > 0""")
def generation_faults(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k)
    late = c.where(k >= 4)
    twice = c.where(k < 4).select(F.floor(k / 2).alias("ordinal"), k.alias("path"))
    entries = late.select(k.alias("ordinal"), k.alias("path")).unionByName(twice)
    cat = entries.select("ordinal", F.col("path").cast("string").alias("path"), F.lit("h").alias("content_sha256"), F.when((F.col("path") % 9 == 0) | (F.col("path") < 4), F.current_timestamp()).alias("tombstone_at"), F.lit(None).cast("string").alias("duplicate_of"), F.lit("default").alias("retrieval_scope"))
    docs = late.where(k % 10 > 0).select(k.alias("ordinal"), F.when(k % 7 == 0, "other").otherwise("h").alias("content_sha256"))
    o = table(spark, sf_dir, "orders").where("o_custkey >= 4")
    tables = {"catalog": cat, "documents": docs, "chunks": o.select(F.col("o_custkey").alias("ordinal")), "temporal": late.select(k.alias("ordinal")), "hierarchy": docs.select("ordinal"), "postings": late.where(k % 4 == 0).select(k.alias("id"))}
    return catalog.faults(tables)
