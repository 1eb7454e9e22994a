"""Queries over what documents are about: topics of a manifest, contexts, overrides and the groups that follow."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import manifest, taxonomy

TOPICS = [
    ("words", "motion", "Motion", ["thble", "of the"], False), ("words", "habit", "Habit", ["than", "thha"], False), ("words", "romance", "Romance", ["que", "là"], False),
    ("endings", "endings", "Endings", ["ther", "erin"], False), ("endings", "glue", "Glue", ["and", "with"], True), ("endings", "small", "Small words", ["le", "de"], True),
]
FIXED = {
    "product": taxonomy.PRODUCT_TERMS, "prompt": taxonomy.PROMPT_TERMS, "skill": taxonomy.SKILL_TERMS, "academic": taxonomy.ACADEMIC_TERMS, "project": taxonomy.PROJECT_TERMS,
    **{key: words for key, _, words, _ in taxonomy.PRODUCT_DOMAINS},
}


def _manifest() -> str:
    themes = dict.fromkeys(t[0] for t in TOPICS)
    return json.dumps({"themes": [{"key": k, "label": k, "color": "#102030", "topics": [{"key": t[1], "label": t[2], "terms": t[3], "context_only": t[4]} for t in TOPICS if t[0] == k]} for k in themes]})


def _docs(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    folder = F.when(i % 5 == 0, "projects/a").when(i % 5 == 1, "u/lectures").when(i % 40 == 2, "x/product-manager-prompts").otherwise(F.coalesce("source", F.lit("none")))
    lead = F.when(i % 9 == 4, "type: knowledge-card\n").when(i % 9 == 5, "Prompt template of a product manager. Input: output:\n").when(i % 9 == 6, "Product management: launch, growth and workflow\n").when(i % 9 == 7, "课程讲义\n").otherwise("")
    tag = lambda n, name: F.when(i % n == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return d.select(
        i.alias("id"), F.concat(folder, F.lit("/"), i.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Note "), i.cast("string")).alias("title"),
        F.concat(tag(13, "knowledge-point-habit"), tag(11, "PM-domain_data-tools"), tag(29, "pm skill"), tag(31, "knowledge point small")).alias("tags"),
        F.concat(lead, F.coalesce("text", F.lit(""))).alias("content"), F.when(i % 17 == 0, "Habit").when(i % 17 == 1, "Own-thing").alias("primary"),
        F.when(i % 19 == 0, "chosen").alias("theme"), F.when(i % 23 == 0, F.array(F.lit("motion"), F.lit("new one"), F.lit("Motion"))).alias("others"),
    )


def _terms() -> str:
    """Rows of (grp, ord, term, pattern, d): an ASCII term's pattern fits a text whose separators are doubled."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for grp, words in [*((t[1], t[3]) for t in TOPICS), *FIXED.items()]:
        for at, w in enumerate(words):
            body = "".join(re.escape(c) * (1 if c in "abcdefghijklmnopqrstuvwxyz0123456789" else 2) for c in w)
            pattern = f"[^a-z0-9]{body}[^a-z0-9]" if w.isascii() else ""
            rows.append(f"({quote(grp)}, {at}, {quote(w)}, {quote(pattern)}, {1.35 if ' ' in w or len(w) >= 4 else 1.0})")
    return ", ".join(rows)


_POINT = "{{'key': {}, 'label': {}, 'theme': {}, 'score': CAST({} AS DOUBLE), 'evidence': {}}}"

PROFILES_SQL = f"""d AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'projects/a' WHEN doc_id % 5 = 1 THEN 'u/lectures' WHEN doc_id % 40 = 2 THEN 'x/product-manager-prompts' ELSE coalesce(source, 'none') END || '/' || doc_id || '.md' AS path,
    'Note ' || doc_id AS title, doc_id % 13 = 0 AS habit, doc_id % 11 = 0 AS tools, doc_id % 29 = 0 AS pm, doc_id % 31 = 0 AS small,
    CASE doc_id % 9 WHEN 4 THEN 'type: knowledge-card' || chr(10) WHEN 5 THEN 'Prompt template of a product manager. Input: output:' || chr(10) WHEN 6 THEN 'Product management: launch, growth and workflow' || chr(10) WHEN 7 THEN '课程讲义' || chr(10) ELSE '' END || coalesce(text, '') AS content,
    CASE doc_id % 17 WHEN 0 THEN 'habit' WHEN 1 THEN 'own-thing' END AS prim, CASE WHEN doc_id % 19 = 0 THEN 'chosen' END AS theme, doc_id % 23 = 0 AS others FROM documents),
x AS (SELECT *, lower(CASE WHEN trim(content) <> '' THEN content ELSE title || chr(10) || path END) AS s,
    lower(title || chr(10) || content || chr(10) || array_to_string(list_filter([CASE WHEN habit THEN 'knowledge-point-habit' END, CASE WHEN tools THEN 'PM-domain_data-tools' END, CASE WHEN pm THEN 'pm skill' END, CASE WHEN small THEN 'knowledge point small' END], lambda v: v IS NOT NULL), chr(10))) AS whole FROM d),
g AS (SELECT * FROM (VALUES {_terms()}) v(grp, ord, term, pattern, d)),
tops AS (SELECT * FROM (VALUES {", ".join(f"('{t[1]}', '{t[2]}', '{t[0]}', {t[4]})" for t in TOPICS)}) v(grp, label, theme, side)),
y AS (SELECT id, s, ' ' || regexp_replace(s, '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS dd FROM x),
n AS (SELECT id, grp, ord, d, CASE WHEN pattern = '' THEN (length(s) - length(replace(s, term, ''))) // length(term) ELSE len(regexp_extract_all(dd, pattern)) END AS n FROM y JOIN g ON contains(s, term)),
sc AS (SELECT id, grp, sum(CAST(d AS DOUBLE) * (1 + CAST(0.35 AS DOUBLE) * least(n - 1, 3)) ORDER BY ord) AS score FROM n WHERE n > 0 GROUP BY 1, 2),
ev AS (SELECT id, grp, list(term ORDER BY ord)[1:8] AS evidence FROM x JOIN g ON contains(whole, term) WHERE grp IN (SELECT grp FROM tops) GROUP BY 1, 2),
pt AS (SELECT x.id, tops.*, coalesce(score, 0) + CASE WHEN grp = 'habit' AND habit OR grp = 'small' AND small THEN 12 ELSE 0 END AS score, coalesce(evidence, CAST([] AS VARCHAR[])) AS evidence
  FROM x CROSS JOIN tops LEFT JOIN sc USING (id, grp) LEFT JOIN ev USING (id, grp)),
nat AS (SELECT id, list({_POINT.format("grp", "label", "theme", "score", "evidence")} ORDER BY score DESC, grp) FILTER (NOT side AND score >= 1) AS nat, coalesce(list(grp ORDER BY score DESC, grp) FILTER (side AND score >= 1), CAST([] AS VARCHAR[])) AS context_topics,
  first(evidence) FILTER (grp = 'habit') AS ev_habit, first(evidence) FILTER (grp = 'motion') AS ev_motion FROM pt GROUP BY 1),
f AS (SELECT x.*, nat.context_topics, coalesce(nat, []) AS nat, ev_motion, CASE prim WHEN 'habit' THEN {_POINT.format("'habit'", "'Habit'", "coalesce(theme, 'words')", "1e15", "ev_habit")} WHEN 'own-thing' THEN {_POINT.format("'own-thing'", "'Own thing'", "coalesce(theme, 'custom:theme')", "1e15", "CAST([] AS VARCHAR[])")} END AS lead FROM x JOIN nat USING (id)),
p1 AS (SELECT *, CASE WHEN prim IS NOT NULL THEN list_concat([lead], list_filter(nat, lambda p: p.key <> lead.key)) WHEN theme IS NOT NULL AND len(nat) > 0 THEN list_concat([{_POINT.format("nat[1].key", "nat[1].label", "theme", "nat[1].score", "nat[1].evidence")}], nat[2:]) ELSE nat END AS p1 FROM f),
p2 AS (SELECT *, list_filter([{_POINT.format("'motion'", "'Motion'", "coalesce(theme, 'words')", "1e15", "ev_motion")}, {_POINT.format("'new-one'", "'new one'", "coalesce(theme, 'custom:theme')", "1e15", "CAST([] AS VARCHAR[])")}], lambda p: p.key <> coalesce(p1[1].key, '')) AS oth FROM p1),
p3 AS (SELECT *, CASE WHEN others AND len(p1) > 0 THEN list_concat(p1[1:1], oth) ELSE p1 END AS points, CASE WHEN others THEN oth ELSE p1[2:] END AS secondary FROM p2),
z AS (SELECT id, {", ".join(f"coalesce(max(score) FILTER (grp = '{k}'), 0) AS \"s_{k}\"" for k in FIXED)} FROM x LEFT JOIN sc USING (id) GROUP BY 1),
c AS (SELECT p3.*, z.* EXCLUDE (id), contains(path, 'product-manager') AS corpus, s_academic + CASE WHEN contains(path, '/lectures/') THEN 3 ELSE 0 END AS aca, s_project + CASE WHEN starts_with(path, 'projects/') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s, 'type:\\s*knowledge-card') THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(s, '(?s)scope:.{{0,120}}(?:work|competition)') THEN 2 ELSE 0 END AS pro FROM p3 JOIN z USING (id)),
profiles AS (SELECT id, title, CASE WHEN aca >= 2.7 AND aca > pro + 0.7 THEN 'academic' WHEN pro >= 2.4 THEN 'project' ELSE 'reference' END AS context,
  (s_product >= 2.1 OR s_product >= 1.3 AND greatest(s_prompt, s_skill) >= 1 OR corpus OR pm) AND NOT (NOT corpus AND aca >= 2.7) AS product, CASE WHEN corpus OR s_prompt >= 2.2 AND s_prompt > s_skill * 0.72 THEN 'prompt' ELSE 'skill' END AS kind,
  CASE WHEN tools THEN 'data-tools' WHEN greatest("s_strategy-discovery", "s_execution-growth", "s_data-tools") = 0 THEN 'execution-growth' WHEN "s_data-tools" >= greatest("s_strategy-discovery", "s_execution-growth") THEN 'data-tools' WHEN "s_execution-growth" >= "s_strategy-discovery" THEN 'execution-growth' ELSE 'strategy-discovery' END AS domain, points, secondary, context_topics FROM c)"""


def _told(column):
    """Points as one text: key, theme, ten thousandths of the score (a chosen topic's as a million), evidence."""
    one = lambda p: F.concat_ws("|", p["key"], p["theme"], F.round(F.least(p["score"], F.lit(100.0)) * 10000).cast("long").cast("string"), F.array_join(p["evidence"], ","))
    return F.array_join(F.transform(column, one), ";")


_TOLD_SQL = "array_to_string(list_transform({}, lambda p: concat_ws('|', p.key, p.theme, CAST(CAST(round(least(p.score, 100) * 10000) AS BIGINT) AS VARCHAR), array_to_string(p.evidence, ','))), ';')"


@query("knowledge_profile", f"""WITH {PROFILES_SQL}
SELECT id, context, product, kind, domain, {_TOLD_SQL.format("points")} AS points, {_TOLD_SQL.format("secondary")} AS secondary, array_to_string(context_topics, ',') AS context_topics FROM profiles""")  # fmt: skip
def knowledge_profile(spark, sf_dir):
    topics, _ = manifest.topics_table(spark, _manifest())
    p = taxonomy.profile(_docs(spark, sf_dir), topics)
    return p.select("id", "context", "product", "kind", "domain", _told("points").alias("points"), _told("secondary").alias("secondary"), F.array_join("context_topics", ",").alias("context_topics"))


@query("knowledge_groups", f"""WITH {PROFILES_SQL}, j AS (SELECT p.*, CASE WHEN id % 4 = 0 THEN 'area/part-' || (id % 3) WHEN id % 4 = 1 THEN 'area/index' ELSE '@root:' || id END AS folder FROM profiles p),
a AS (SELECT id, CASE WHEN product AND kind = 'prompt' THEN '@topic:pm-prompts' WHEN product THEN '@topic:pm-skills:' || domain WHEN len(points) > 0 THEN '@knowledge:' || points[1].key WHEN context = 'academic' THEN '@knowledge:academic-research' WHEN id % 4 = 0 THEN folder ELSE '@root:' || id END AS key,
  CASE WHEN product AND kind = 'prompt' THEN 'PM Prompts' WHEN product THEN CASE domain WHEN 'strategy-discovery' THEN 'PM Strategy & Discovery' WHEN 'data-tools' THEN 'PM Data & Tools' ELSE 'PM Execution & Growth' END WHEN len(points) > 0 THEN points[1].label WHEN context = 'academic' THEN '学术研究方法' WHEN id % 4 = 0 THEN 'part ' || (id % 3) ELSE title END AS label,
  CASE WHEN NOT product THEN points[1].theme END AS parent, CAST(CASE WHEN product THEN 0.12 ELSE 1.0 END AS DOUBLE) AS weight, CASE WHEN product THEN 'product-management' ELSE context END AS contexts,
  CASE WHEN product THEN 'product-management,' || kind || ',' || domain ELSE array_to_string(list_transform(CASE WHEN len(points) > 0 THEN points ELSE secondary END, lambda p: p.key), ',') END AS topics FROM j)
SELECT *, count(*) OVER (PARTITION BY key) AS size FROM a""")  # fmt: skip
def knowledge_groups(spark, sf_dir):
    topics, _ = manifest.topics_table(spark, _manifest())
    docs, i = _docs(spark, sf_dir), F.col("id")
    folder = F.when(i % 4 == 0, F.concat(F.lit("area/part-"), (i % 3).cast("string"))).when(i % 4 == 1, "area/index").otherwise(F.concat(F.lit("@root:"), i.cast("string")))
    got = taxonomy.assign(docs, taxonomy.profile(docs, topics), docs.select("id", folder.alias("project")))
    return got.select("id", "key", "label", "parent", "weight", F.array_join("contexts", ",").alias("contexts"), F.array_join("topics", ",").alias("topics"), "size")
