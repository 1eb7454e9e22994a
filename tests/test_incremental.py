"""Builds that cost what changed: segments, units and vectors that are kept, compaction, resuming, and settings that act."""

import os
import unicodedata
from dataclasses import dataclass
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.operators import catalog, compiler, segments
from tessera.sources.settings import BuildPolicy
from tessera.sources.store import Conflict, Segmented, Store

TABLES = ("documents", "chunks", "chunk_postings", "postings", "temporal", "hierarchy", "vectors")


@dataclass(frozen=True)
class Counting:
    """Hashing that notes each text that it is asked for."""

    log: str
    fail: str = ""
    dims: int = 8
    id: str = "counting"
    model: str = "m"
    kind: str = "lexical_hash"

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        if self.fail and os.path.exists(self.fail):
            raise RuntimeError("no model")
        return embedding.HashAdapter(self.dims).embed(texts)

    def asked(self):
        if not os.path.exists(self.log):
            return []
        with open(self.log) as f:
            out = f.read().splitlines()
        os.unlink(self.log)
        return out


def write(root, **notes):
    for name, body in notes.items():
        p = root / (name.replace("__", "/") + ".md")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)


def note(n, extra=""):
    return f"---\ntitle: Note {n}\ntags: [t{n % 3}]\n---\n# Top {n}\n" + "\n".join(f"word{n} common line {k} of the note" for k in range(12)) + f"\n## Part\n{extra or 'the last part of it ' * 20} {n}\n"


def rows(store, name):
    """A table's rows without ordinals, which depend on the order of builds."""
    df, paths = store.read(name), store.read("catalog").select("ordinal", F.col("path").alias("_path"))
    key = "id" if name == "postings" else "ordinal"
    df = df.join(paths.withColumnRenamed("ordinal", key), key).drop(key)
    return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())


@pytest.fixture(scope="module", autouse=True)
def few_tasks(spark):
    """The notes are few; what is tested is which rows are written."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def place(spark, tmp_path):
    src, adapter = tmp_path / "src", Counting(str(tmp_path / "asked"), str(tmp_path / "fails"))
    store = Store(spark, f"file://{tmp_path}/out")
    return src, store, compiler.Compiler(spark, "s", str(src), store, BuildPolicy.merged({"chunk": 300}), adapter=adapter), adapter


def test_a_changed_note_costs_its_own_rows(spark, tmp_path, place):
    src, store, c, adapter = place
    write(src, **{f"projects__n{k}": note(k) for k in range(12)}, projects__z=note(3))
    first = c.build(now=datetime(2024, 1, 1))
    assert (first.compiled, first.compacted) == (13, True)
    assert len(adapter.asked()) == store.read("chunks").count() > 24
    write(src, projects__n5=note(5, "another last part " * 20))
    second = c.build(now=datetime(2024, 1, 2))
    assert (second.compiled, second.reused, second.compacted) == (1, 12, False)
    told = adapter.asked()
    assert 0 < len(told) < store.part("chunks", second.generation).count() and all("another last part" in t for t in told)
    for name in ("documents", "chunks", "units"):
        assert {r["path"] for r in store.part(name, second.generation).select("path").collect()} == {"projects/n5.md"}
    assert store.part("vectors", second.generation).count() == store.part("chunks", second.generation).count()
    # a copy takes the place of the note that goes; a note comes; a file is touched only
    (src / "projects/n3.md").unlink()
    write(src, projects__new=note(40))
    os.utime(src / "projects/n7.md", (1, 1))
    third = c.build(now=datetime(2024, 1, 3))
    assert (third.compiled, third.tombstones, third.duplicates) == (1, 1, 0)
    assert {r["path"] for r in store.part("chunks", third.generation).select("path").collect()} == {"projects/z.md", "projects/new.md"}
    assert {r["path"] for r in store.part("documents", third.generation).select("path").collect()} == {"projects/z.md", "projects/new.md", "projects/n7.md"}
    assert len(adapter.asked()) == store.part("chunks", third.generation).count()
    # base and deltas are what a whole build gives
    whole = Store(spark, f"file://{tmp_path}/whole")
    compiler.Compiler(spark, "s", str(src), whole, c.policy, adapter=adapter).build(now=datetime(2024, 1, 3))
    for name in TABLES:
        assert rows(store, name) == rows(whole, name), name
    tables = {n: store.read(n) for n in (*TABLES, "catalog")}
    assert catalog.faults(tables).isEmpty() and store.verify() == []
    # the segments' generations stay while they are read, and go once they are merged
    assert store.prune() == [] and len(store.manifest(third.generation)["segments"]["chunks"]["parts"]) == 3
    adapter.asked()
    merged = c.build(compact=True, now=datetime(2024, 1, 4))
    assert merged.compacted and merged.compiled == 0 and adapter.asked() == [] and not store.manifest(merged.generation)["segments"]
    for name in ("chunks", "postings", "vectors"):
        assert rows(store, name) == rows(whole, name), name
    assert store.prune() == []  # the parent still reads the others


def test_deltas_are_merged_when_they_are_many_or_large(spark, tmp_path, place):
    src, store, _, adapter = place
    c = compiler.Compiler(spark, "s", str(src), store, BuildPolicy.merged({"most_deltas": 1, "most_replaced": 0.5}), adapter=adapter)
    write(src, **{f"projects__n{k}": note(k) for k in range(4)})
    c.build()
    seen = []
    for k in range(2):
        write(src, projects__n0=note(0, f"turn {k} " * 10))
        seen.append(c.build().compacted)
    assert seen == [False, True]
    write(src, **{f"projects__n{k}": note(k, "all new ") for k in range(3)})
    assert c.build().compacted


def test_a_broken_build_goes_on_where_it_stopped(spark, tmp_path, place):
    src, store, c, adapter = place
    write(src, **{f"projects__n{k}": note(k) for k in range(6)})
    (tmp_path / "fails").write_text("x")
    with pytest.raises(Exception, match="no model"):
        c.build()
    assert store.current() is None
    (tmp_path / "fails").unlink()
    report = c.build()
    assert (report.compiled, report.resumed) == (6, 6)
    # set aside for another plan: not used
    (tmp_path / "fails").write_text("x")
    write(src, projects__n1=note(1, "changed"))
    with pytest.raises(Exception, match="no model"):
        c.build()
    (tmp_path / "fails").unlink()
    write(src, projects__n1=note(1, "changed again"))
    report = c.build()
    assert (report.compiled, report.resumed) == (1, 0)
    assert "changed again" in " ".join(r["content"] for r in store.read("chunks").where("path = 'projects/n1.md'").collect())


def test_batches_are_resumed_one_by_one(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", Store(spark, f"file://{tmp_path}/out")
    write(src, **{f"projects__n{k}": note(k) for k in range(9)})
    c = compiler.Compiler(spark, "s", str(src), store, batch=3)
    whole, calls = catalog.compile_notes, []

    def stops(*a):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the executor is gone")
        return whole(*a)

    monkeypatch.setattr(catalog, "compile_notes", stops)
    with pytest.raises(RuntimeError):
        c.build()
    report = c.build()
    assert len(calls) == 4 and report.compiled == 9 and 0 < report.resumed < 9 and store.read("units").count() == 9


def test_settings_act_on_the_scan(spark, tmp_path):
    src = tmp_path / "src"
    write(src, projects__a=note(1), private__c=note(2))
    build = lambda k, **policy: compiler.Compiler(spark, "s", str(src), Store(spark, f"file://{tmp_path}/out{k}"), BuildPolicy.merged(policy)).build()
    assert build(1, ignored=["private"]).compiled == 1 and build(2).compiled == 2
    assert {r["path"] for r in Store(spark, f"file://{tmp_path}/out1").read("units").collect()} == {"projects/a.md"}
    with pytest.raises(compiler.SourceRefused, match="2 files"):
        build(3, most_files=1)
    with pytest.raises(compiler.SourceRefused, match="larger"):
        build(4, most_bytes=100)
    assert build(5, most_files=1, ignored=["private"]).compiled == 1  # what is ignored does not count
    for form in ("NFC", "NFD"):
        write(src, **{"projects__" + unicodedata.normalize(form, "é"): "text"})
    with pytest.raises(compiler.SourceRefused, match="two files"):
        build(6)


def test_odd_names_are_compiled(spark, tmp_path):
    src = tmp_path / "src"
    write(src, **{"projects__a [x] {1}*": note(1), "projects__b b": note(2)})
    store = Store(spark, f"file://{tmp_path}/out")
    assert compiler.Compiler(spark, "s", str(src), store).build().compiled == 2
    assert {r["path"] for r in store.read("units").collect()} == {"projects/a [x] {1}*.md", "projects/b b.md"}


def test_one_build_at_a_time(spark, tmp_path, place):
    src, store, c, _ = place
    write(src, projects__a=note(1))
    with store.locked("someone", 60), pytest.raises(Conflict, match="someone"):
        c.build()
    with store.locked("slow", -1):  # its time is up
        assert c.build().published
    assert not c.build().published


def test_segments(spark):
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    keys = lambda *r: spark.createDataFrame([(k,) for k in r], "key long")
    parts = [(df((1, "a"), (2, "b"), (2, "bb"), (None, "n")), keys(1)), (df((2, "c")), keys(2, 9)), (df((9, "x"), (1, "z")), keys(1, 1)), (df(), None)]
    got = sorted(map(tuple, segments.merged(parts, "k", "key").collect()), key=str)
    assert got == sorted([(2, "c"), (None, "n"), (9, "x"), (1, "z")], key=str)
    assert segments.merged(parts[:1], "k", "key").count() == 4
    with pytest.raises(ValueError):
        segments.merged([], "k")
    assert segments.due(9, 0, 100) and segments.due(1, 36, 100) and not segments.due(8, 35, 100)


def test_a_damaged_segment_is_found(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    gone = spark.createDataFrame([(1,)], "key long")
    g1 = store.publish({"t": rows((1, "a"), (2, "b"))})
    g2 = store.publish({"t": rows((1, "c")), "gone": gone}, expected=g1, deltas={"t": Segmented("k", "gone")})
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "c"), (2, "b")] and store.verify() == []
    assert store.read("t", g1).count() == 2
    for f in (tmp_path / "s" / g1 / "t").glob("*.parquet"):
        f.unlink()
    assert store.verify(g2) == ["t"] and store.damaged(g2) == []
