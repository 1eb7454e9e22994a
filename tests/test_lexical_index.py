"""Searches from stored postings give what searches over everything give."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.plans.retrieval import notes_and_chunks

NOTES = [
    (1, "a/one.md", "Database design", ["db"], ["sql"], ["Joins and keys"]), (2, "a/two.md", "Other", [], [], ["Joins"]), (3, "b/three.md", "Third", [], ["sql"], []),
    (4, "b/four.md", "Ｆｕｌｌ width", None, ["wide"], []), (5, None, None, None, None, None), (6, "c/empty.md", "Lonely note", [], [], []),
]
CHUNKS = [
    (1, 0, "normal forms and keys of a database"), (1, 1, "query plans. Query plans again"), (2, 0, "nothing of note"), (2, 1, "a database of sorts, normal  forms"), (3, 0, "sql sql sql"),
    (4, 0, "ｎｏｒｍａｌ ｆｏｒｍｓ here"), (5, 0, None), (5, 1, "query database sql normal"), (3, 1, ""),
]
QUERIES = ["database", "normal forms", "sql", "sql database query", "normal", "find the lonely note", "nothing", "keys of", "full width", "zzqqx", "the", "query plans", "wide joins"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    notes = spark.createDataFrame(NOTES, "id long, path string, title string, aliases array<string>, tags array<string>, headings array<string>")
    chunks = spark.createDataFrame(CHUNKS, "id long, chunk int, content string")
    root = f"file://{tmp_path_factory.mktemp('index')}"
    lexical.index(notes, chunks, lexical.stored_index(spark, root), buckets=4)
    return notes, chunks, lexical.open_index(spark, root)


def rows(df):
    return sorted((r["id"], r["path"] or "", r["chunk"], round(r["score"], 9), tuple(r["matched_fields"])) for r in df.collect())


def test_index_equals_search(small):
    notes, chunks, stored = small
    for q in QUERIES:
        assert rows(lexical.search_index(stored, q, buckets=4)) == rows(lexical.search(notes, chunks, q)), q


def test_full_width_words_are_found_by_their_plain_form(small):
    notes, chunks, stored = small
    assert 4 in {r["id"] for r in lexical.search(notes, chunks, "normal forms").collect()}
    assert {r["id"] for r in lexical.search_index(stored, "full width", buckets=4).collect()} == {4}


def test_only_the_terms_folders_are_read(small):
    stored = small[2]
    plan = stored["postings"].where((F.col("bucket") == lexical._bucket(F.lit("sql"), 4)) & F.col("term").isin(["sql"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text and "EqualTo(term,sql)" in text
    whole = lexical.search_index(stored, "sql keys", buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in whole and "ArrowEvalPython" not in whole


def test_whole_documents(spark, sf, tmp_path):
    notes, parts = notes_and_chunks(spark, sf)
    root = f"file://{tmp_path}/i"
    lexical.index(notes, parts, lexical.stored_index(spark, root), buckets=2)
    stored = lexical.open_index(spark, root)
    for q in ("blewh thing ouen", "tion"):
        assert rows(lexical.search_index(stored, q, buckets=2)) == rows(lexical.search(notes, parts, q))


def test_search_reads_each_chunk_once(spark):
    notes = spark.createDataFrame([(i, f"{i}.md", f"note {i}", [], [], []) for i in range(6)], "id long, path string, title string, aliases array<string>, tags array<string>, headings array<string>")
    chunks = spark.range(6).select("id", F.lit(0).alias("chunk"), F.when(F.col("id") < 3, "alpha beta").otherwise("gamma").alias("content"))
    out = lexical.search(notes, chunks, "alpha beta")
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2]
