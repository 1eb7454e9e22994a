"""Matching many terms at once, and what profiles say of documents."""

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import terms, text
from tessera.operators import graph, topics
from tessera.sources import manifest, taxonomy


def counted(value, term):
    bound = (r"(?<![a-z0-9])", r"(?![a-z0-9])") if term.isascii() else ("", "")
    return min(4, len(re.findall(bound[0] + re.escape(term) + bound[1], value)))


def test_matcher_equals_one_search_per_term():
    r = random.Random(3)
    words = ["a", "aa", "aaa", "a a", "ab", "b a", "b", "a.b", "课", "课程", "程课", "a课", ""]
    for _ in range(300):
        groups = [r.choices(words, k=r.randint(0, 6)) for _ in range(4)]
        value = "".join(r.choices(["a", "b", " ", ".", "课", "程", "a a"], k=r.randint(0, 40)))
        m = terms.Matcher(groups)
        got = {m.terms[i]: n for i, n in m.counts(value).items()}
        assert got == {t: counted(value, t) for g in groups for t in g if t and counted(value, t)}
        held = [[t for t in g if t and t in value][:8] for g in groups]
        assert m.evidence(value, 4) == held
    assert terms.Matcher([]).scores("x") == [] and terms.Matcher([[""], []]).scores("x") == [0.0, 0.0]


def test_scores_equal_the_column_of_each_term(spark):
    lists = [["alpha", "be", "of the"], ["讲义", "alpha"], []]
    rows = [("alpha alpha. be of the of the alpha alpha alpha",), ("alphabet 讲义讲义",), ("",), (None,), ("be " * 200_000,)]
    df = spark.createDataFrame(rows, "t string")
    each = [sum((text.term_weight(F.col("t"), F.lit(w)) for w in ws), F.lit(0.0)) for ws in lists]
    for row in df.select(terms.weighed(F.col("t"), F.col("t"), lists, 1).alias("w"), *[F.coalesce(e, F.lit(0.0)).alias(f"e{i}") for i, e in enumerate(each)]).collect():
        assert row["w"]["scores"] == [row["e0"], row["e1"], row["e2"]] and len(row["w"]["evidence"]) == 1


def test_few_texts_are_python_values_at_a_time(spark):
    texts = [None if i % 50 == 3 else "ﬁrst ﾃｽﾄ " * (i % 7) + ("alpha " * (i % 5)) for i in range(3 * text.AT_ONCE + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = df.select("i", text.nfkc(F.col("t")).alias("n"), terms.weighed(F.col("t"), F.col("t"), [["alpha"]], 1).alias("w")).orderBy("i").collect()
    m = terms.Matcher([["alpha"]])
    assert [r["n"] for r in got] == [x and unicodedata.normalize("NFKC", x) for x in texts]
    assert [(r["w"]["scores"], r["w"]["evidence"]) for r in got] == [(m.scores(x or ""), m.evidence(x or "", 1)) for x in texts]
    assert max(s.stop - s.start for s in text.in_slices(len(texts))) == text.AT_ONCE and not list(text.in_slices(0))


def test_context_only_topics_and_evidence(spark):
    themes = [{"key": "t", "label": "T", "color": "#000000", "topics": [
        {"key": "side", "label": "Side", "terms": ["kept aside"], "context_only": True}, {"key": "main", "label": "Main", "terms": ["chief", "first", "leading"]},
    ]}]
    table, warning = manifest.topics_table(spark, json.dumps({"themes": themes}))
    assert warning is None and [r["context_only"] for r in table.orderBy("topic").collect()] == [False, True]
    rows = [
        (1, "a.md", "A", None, "Kept aside, not chief", ["First"], None), (2, "b.md", "leading", [], "nothing at all", None, "Main"),
        (3, "c.md", "C", ["knowledge-point-side"], "", None, None), (4, None, None, None, None, None, "Side"), (5, "e.md", "E", [], "chief " * 100_000, None, None),
    ]
    docs = spark.createDataFrame(rows, "id int, path string, title string, tags array<string>, content string, headings array<string>, primary string")
    got = {r["id"]: r for r in taxonomy.profile(docs, table).collect()}
    assert got[1]["context_topics"] == ["side"] and [(p["key"], p["evidence"]) for p in got[1]["points"]] == [("main", ["chief", "first"])]
    assert [(p["key"], p["score"], p["evidence"]) for p in got[2]["points"]] == [("main", taxonomy.CHOSEN, ["leading"])]
    assert got[3]["context_topics"] == ["side"] and got[3]["points"] == []
    assert [(p["key"], p["label"]) for p in got[4]["points"]] == [("side", "Side")] and got[4]["context_topics"] == []  # of its own: side topics are not named
    assert round(got[5]["points"][0]["score"], 6) == round(1.35 * (1 + 0.35 * 3), 6)


def test_a_manifest_of_many_topics_is_one_pass(spark):
    topics = [{"key": f"k{i}", "label": f"L{i}", "terms": [f"term{i}", f"phrase {i} of it"]} for i in range(600)]
    table, _ = manifest.topics_table(spark, json.dumps({"themes": [{"key": "t", "label": "T", "color": "#000000", "topics": topics}]}))
    docs = spark.createDataFrame([(1, "a.md", "A", "term7 and phrase 599 of it, phrase 599 of it")], "id int, path string, title string, content string").withColumn("tags", F.array().cast("array<string>"))
    p = taxonomy.profile(docs, table)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 3 and "RegExpCount" not in plan
    assert [x["key"] for x in p.first()["points"]] == ["k599", "k7"]


def test_labels_follow_the_order_of_keywords_and_projects(spark):
    members = spark.createDataFrame([(0, n, "p" if n < 2 else None, ["often", "told"] if n < 6 else ["often"]) for n in range(8)], "community int, node int, project string, priority array<string>")
    none = spark.createDataFrame([], "node int, term string, w double")
    label = lambda **k: topics.community_labels(members, none, **k).first()["label"]
    assert label() == "p" and label(by_project=False) == "often" and label(by_project=False, order=["told"]) == "told"
    assert topics.community_labels(members.where("node = 0"), none).first()["label"] == "Community"


def test_parents_need_more_than_half(spark):
    assigned = spark.createDataFrame([(n, n // 4) for n in range(12)] + [(99, -1)], "node int, community int")
    parents = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (4, "a"), (5, "a"), (8, "a"), (9, "a"), (10, "a"), (11, "a")], "node int, parent string")
    clusters = graph.cluster_summary(assigned, spark.createDataFrame([(0, 1, 1.0)], "src int, dst int, w double"), spark.createDataFrame([(3, 0.1)], "node int, display_weight double"))
    got = graph.cluster_parents(assigned, parents, clusters).collect()
    assert [(r["parent"], r["size"], r["visible"], r["communities"]) for r in got] == [("a", 8, 7, [0, 2])]
