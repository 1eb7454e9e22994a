import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.sources import manifest, markdown
from tessera.sources.store import Conflict, Store

NOTE = """---
title: "First note"
aliases: [one, uno]
tags:
  - data/base
  - '#quoted'
status: active # comment
---
intro #inline text
# Top
body
```
# not a heading
```
## Sub ##
[[Other|label]] and [x](b/c.md#h)
"""


def test_frontmatter():
    fields, title, aliases, tags, start, wrong = markdown.parse_frontmatter(NOTE)
    assert (title, aliases, tags, start, wrong) == ("First note", ["one", "uno"], ["data/base", "quoted"], 8, False)
    assert fields["status"] == ["active"]
    assert markdown.parse_frontmatter("no front")[4:] == (0, False)
    bad = ["---\nstatus: a\nstatus: b\n---\n", "---\nscope", "---\n? odd\n---\n", "---\nsensitivity: [a]\n---\n", "---\narchived: maybe\n---\n", "---\nstatus: !tag x\n---\n", "---\ntype:\n  - x\n---\n"]
    assert all(markdown.parse_frontmatter(b)[5] for b in bad)
    assert markdown.parse_frontmatter("---\ntitle: null\n---\n")[1] is None
    assert markdown.parse_frontmatter("---\ntitle: null\n---\n", compiled=True)[1] == "null"


def test_headings_tags_links(spark):
    lines = NOTE.split("\n")
    assert markdown.headings(lines, 8) == [("Top", 1, 9), ("Sub", 2, 14)]
    assert markdown.headings(["~~~", "# a", "```", "~~~", "# b"]) == [("b", 1, 4)]
    assert markdown.inline_tags(lines, 8) == ["inline"]
    assert spark.range(1).select(markdown.links(F.lit(NOTE)).alias("x")).first()["x"] == ["Other", "b/c.md"]
    assert markdown.read_section(NOTE, "sub").startswith("## Sub") and markdown.read_section(NOTE, "none") == ""


def test_chunks(spark):
    rows = [(1, NOTE), (2, "x" * 500), (3, None), (4, "\n".join(["line %d" % i for i in range(100)])), (5, "字" * 300)]
    got = markdown.chunks(spark.createDataFrame(rows, "id long, content string"), "id", "content", 200, 40).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert [r["heading"] for r in by[1]][-2:] == ["Top", "Top › Sub"]
    assert all(len(r["content"].encode()) <= 200 for r in got)
    assert by[2][0]["start_col"] == 1 and by[2][-1]["end_col"] == 500 and by[2][1]["start_col"] == 161
    assert 3 not in by
    seen = {n for r in by[4] for n in range(r["start_line"], r["end_line"] + 1)}
    assert seen == set(range(1, 101)) and by[4][1]["start_line"] <= by[4][0]["end_line"]
    assert "".join(r["content"] for r in markdown.chunks(spark.createDataFrame([(5, "字" * 300)], "id long, content string"), "id", "content", 200, 0).orderBy("chunk").collect()) == "字" * 300


def test_scan_compile_publish_and_roll_back(spark, tmp_path):
    root = tmp_path / "vault"
    os.makedirs(root / "projects")
    os.makedirs(root / ".git")
    (root / "projects/a.md").write_text(NOTE)
    (root / "projects/b.md").write_text(NOTE)
    (root / ".git/c.md").write_text("hidden")
    (root / "d.md").write_bytes(b"\xff\xfe broken")
    scanned = markdown.scan(spark, str(root))
    assert {r["path"] for r in scanned.collect()} == {"projects/a.md", "projects/b.md", "d.md"}
    assert markdown.same_state(scanned, markdown.scan(spark, str(root))) and markdown.plan_hash(scanned) == markdown.plan_hash(markdown.scan(spark, str(root)).repartition(3))
    from datetime import datetime

    units = catalog.compile_notes(scanned, "vault")
    empty = spark.createDataFrame([], catalog.CATALOG)
    first = catalog.next_catalog(units, empty, datetime(2024, 1, 1)).persist()
    rows = {r["path"]: r for r in first.collect()}
    assert rows["projects/b.md"]["duplicate_of"] == rows["projects/a.md"]["document_id"] and rows["projects/a.md"]["ordinal"] == 0
    tables = catalog.layers(units, first)
    assert catalog.faults(tables).collect() == []
    assert [r["check"] for r in catalog.faults(tables | {"documents": tables["documents"].limit(0)}).collect()] != []
    store = Store(spark, f"file://{tmp_path}/store")
    g1 = store.publish(tables)
    assert store.verify() == [] and store.read("chunks").count() == tables["chunks"].count()
    with pytest.raises(Conflict):
        store.publish(tables)
    spark.catalog.clearCache()  # a new scan of a folder must not meet the old one in the cache
    (root / "projects/a.md").unlink()
    units2 = catalog.compile_notes(markdown.scan(spark, str(root)), "vault")
    second = catalog.next_catalog(units2, store.read("catalog"), datetime(2024, 2, 1)).persist()
    gone = {r["path"]: r["tombstone_at"] for r in second.collect()}
    assert gone["projects/a.md"] == datetime(2024, 2, 1) and gone["projects/b.md"] is None
    assert sorted(r["id"] for r in catalog.replaced_ordinals(store.read("catalog"), second).collect()) == [0, 1]
    g2 = store.publish(catalog.layers(units2, second), expected=g1)
    assert store.current() == g2 and store.rollback() == g1 and store.prune() == [g2]


def test_manifest_and_sources(spark):
    topics, warning = manifest.topics_table(spark, "{broken")
    assert warning and topics.count() == 3
    assert manifest.check_manifest({"themes": [{"key": "a", "label": "A", "color": "red", "topics": []}]})
    docs = spark.createDataFrame([(1, "Query index", ["x"], "database index query"), (2, "Other", ["knowledge-point-method"], "nothing"), (3, "None", [], "none")], "id long, title string, tags array<string>, content string")
    got = {r["id"]: r["topic"] for r in manifest.assign_topics(docs, topics).collect()}
    assert got == {1: "data", 2: "method", 3: None}
    assert len(manifest.sources('[{"id": "a", "root": "/x"}, {"id": "b", "root": "/y"}]')) == 2
    for bad in ('[]', '[{"id": "a", "root": "/x"}, {"id": "b", "root": "/x/y"}]', '[{"id": "a", "root": "/x", "odd": 1}]'):
        with pytest.raises(ValueError):
            manifest.sources(bad)
