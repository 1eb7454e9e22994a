"""Settings, embeddings, taxonomy, builds and the write service, on small inputs."""

import json
import math
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding, ids
from tessera.operators import catalog, channels, compiler, service, visibility, writes
from tessera.plans import search
from tessera.sources import manifest, settings, taxonomy
from tessera.sources.store import Conflict, Store


def test_settings():
    p = settings.BuildPolicy.merged({"ignored": ["drafts"], "chunk": 300})
    assert "drafts" in p.ignored and ".git" in p.ignored and p.chunk == 300
    for bad in ({"chunk": 100}, {"overlap": 300}, {"odd": 1}, {"most_replaced": 0}, {"journal": 1}):
        with pytest.raises(ValueError):
            settings.BuildPolicy.merged(bad)
    assert p.hash("a") != p.hash("b") and p.hash("a") != p.hash("a", {"dims": 3}) and p.hash("a") == settings.BuildPolicy.merged({"ignored": ["drafts"], "chunk": 300, "journal": 99}).hash("a")
    assert settings.limits({"TESSERA_CHUNK": "900"})["chunk"] == 900
    for bad in ({"TESSERA_CHUNK": "x"}, {"TESSERA_CHUNK": "9999"}, {"TESSERA_OVERLAP": "300"}):
        with pytest.raises(ValueError):
            settings.limits(bad)
    own = settings.principal({"TESSERA_ALLOWED_SOURCES": "a", "TESSERA_EXCLUDED_PATHS": "x, y"}, ["a", "b"], ["p"])
    assert own.sources == ("a",) and own.projects == ("p",) and own.exclude == ("x", "y")
    for bad in ({"TESSERA_ALLOWED_SOURCES": "c"}, {"TESSERA_ALLOWED_MODES": "all"}):
        with pytest.raises(ValueError):
            settings.principal(bad, ["a"])
    settings.isolated("/a/out", ["/a/in"])
    for bad in ("/a/in/out", "/a"):
        with pytest.raises(ValueError):
            settings.isolated(bad, ["/a/in"])


def test_path_audit():
    assert settings.path_fault("src/main.py") is None and settings.path_fault("a/.env.example") is None
    faults = {p: settings.path_fault(p) for p in ("", "a\\b", "/a", "a//b", "a/../b", "Vault/x.py", "a/.env", "a/id_rsa", "x.pdf", "x.pem")}
    assert all(faults.values()) and faults["x.pem"] == "a key" and faults["a/.env"] == "a file of credentials"
    assert settings.audited_text("x", "é\n".encode()) == "é\n"
    for raw in (b"\xff", b"a\x00"):
        with pytest.raises(ValueError):
            settings.audited_text("x", raw)


def test_identities_and_times(spark):
    given = {"C:\\A\\b": "win32:c:/a/b", "\\\\?\\C:\\x": "win32:c:/x", "//Host/S": "win32-unc://host/s", "/a/./b/../c/": "posix:/a/c", "/": "posix:/", "HTTP://Ex.org": "uri:http://ex.org/", "../x": "logical:../x", "a/../..": "logical:..", " ": None, ".": None}
    df = spark.createDataFrame([(k,) for k in given], "s string").select("s", ids.source_identity(F.col("s")).alias("i"))
    assert {r["s"]: r["i"] for r in df.collect()} == given
    times = spark.createDataFrame([("2024-02-29T01:02:03.004Z",), ("2023-02-29T01:02:03.004Z",), ("2024-02-29",), (None,)], "s string").select(ids.iso_text(ids.iso_timestamp(F.col("s"))).alias("t"))
    assert [r["t"] for r in times.collect()] == ["2024-02-29T01:02:03.004Z", None, None, None]


class Model(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["content-length"])))["input"]
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked)]
        if "twice" in asked:
            data[0]["index"] = len(data)
        body = json.dumps({"data": data[::-1]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_embedding_adapters(spark):
    own = embedding.HashAdapter(64)
    rows = spark.createDataFrame([(1, "Title", None, ["x"], ["a", "b"], "the body"), (2, "Other", "H", [], None, None)], "id int, title string, heading string, aliases array<string>, hierarchy array<string>, content string")
    told = {r["id"]: r["t"] for r in rows.select("id", channels.search_text(rows).alias("t")).collect()}
    assert told == {1: "Title\n\nx\na\nb\nthe body", 2: "Other\nH\n"}
    got = {r["id"]: r["values"] for r in embedding.record_vectors(rows, own).collect()}
    assert got[1] == pytest.approx(own.embed([told[1]])[0]) and math.isclose(sum(x * x for x in got[1]), 1.0)
    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    loop = embedding.select_adapter({"EMBEDDING": "loopback", "EMBEDDING_PORT": str(server.server_port), "EMBEDDING_MODEL": "m", "EMBEDDING_DIMS": "2"})
    assert embedding.query_vector("abc", loop) == [3.0, 1.0]
    df = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string").coalesce(1)
    assert [r["v"] for r in df.select(embedding.embedded(F.col("t"), loop).alias("v")).collect()] == [[2.0, 1.0], None, [4.0, 1.0]]
    with pytest.raises(ValueError):
        loop.embed(["twice", "x"])
    small = embedding.LoopbackAdapter(server.server_port, "m", 2, most_bytes=1024)
    with pytest.raises(ValueError):
        small.embed(["x"] * 200)
    server.shutdown()
    for bad in ({"EMBEDDING": "x"}, {"EMBEDDING": "loopback"}, {"EMBEDDING_DIMS": "3"}):
        with pytest.raises(ValueError):
            embedding.select_adapter(bad)
    with pytest.raises(ValueError):
        embedding.checked([[float("nan")]], 1, 1)
    assert embedding.contract(own) != embedding.contract(loop)


def test_taxonomy(spark):
    table, _ = manifest.topics_table(spark, None)
    long = "database index query; database index query"
    rows = [
        (1, "a/x.md", "X", [], long, None, None, None), (2, "pm-skills/y.md", "Y", [], "prompt template. system prompt. output:", None, None, None),
        (3, "u/lectures/z.md", "Z", [], "university course lecture", None, None, None), (4, "work/w.md", "W", [], "prototype and milestone and deliverable", None, None, None),
        (5, "q.md", "Q note", [], "nothing", None, None, None), (6, "b/t.md", "T", ["knowledge-point-method"], "x", None, None, None),
        (7, "b/u.md", "U", [], long, "Own topic", "research", ["Software", "own-topic", "new one"]), (8, "b/v.md", "V", None, None, None, None, None),
        (9, "b/p.md", "P", [], "product management and product manager: user story for the sprint, launch", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "id int, path string, title string, tags array<string>, content string, primary string, theme string, others array<string>")
    found = {r["id"]: r for r in taxonomy.profile(docs, table).collect()}
    assert [p["key"] for p in found[1]["points"]] == ["data"] and set(found[1]["points"][0]["evidence"]) == {"database", "index", "query"} and not found[1]["secondary"]
    assert found[3]["context"] == "academic" and found[4]["context"] == "project" and found[5]["context"] == "reference"
    assert found[6]["points"][0]["key"] == "method" and found[6]["points"][0]["score"] == 12.0
    assert [(p["key"], p["theme"]) for p in found[7]["points"]] == [("own-topic", "research"), ("software", "research"), ("new-one", "research")] and len(found[7]["secondary"]) == 2
    assert found[2]["product"] and found[2]["kind"] == "prompt" and found[9]["product"] and found[9]["kind"] == "skill" and found[9]["domain"] == "execution-growth"
    projects = spark.createDataFrame([(1, "a"), (4, "work"), (5, "@root:5"), (8, "b")], "id int, project string")
    got = {r["id"]: r for r in taxonomy.assign(docs, taxonomy.profile(docs, table), projects).collect()}
    keys = {k: r["key"] for k, r in got.items()}
    assert keys == {1: "@knowledge:data", 2: "@topic:pm-prompts", 3: "@knowledge:academic-research", 4: "work", 5: "@root:5", 6: "@knowledge:method", 7: "@knowledge:own-topic", 8: "b", 9: "@topic:pm-skills:execution-growth"}
    assert got[5]["label"] == "Q note" and got[2]["weight"] == 0.12 and got[2]["contexts"] == ["product-management"] and got[1]["parent"] == "engineering"


def folder(root, **notes):
    for name, body in notes.items():
        p = root / f"{name}.md"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)


def test_builds_reuse_and_follow(spark, tmp_path):
    src = tmp_path / "projects"
    folder(src, a="---\ntitle: A\n---\n# Top\nalpha beta text here", b="beta gamma words in it")
    store = Store(spark, f"file://{tmp_path}/out")
    c = compiler.Compiler(spark, "s", str(src), store, adapter=embedding.HashAdapter(16))
    first = c.build(now=datetime(2024, 1, 1))
    assert first.published and (first.compiled, first.reused) == (2, 0) and store.read("vectors").count() == store.read("chunks").count()
    again = c.build()
    assert not again.published and again.generation == first.generation and again.reused == 2
    folder(src, b="beta gamma other words", d="delta")
    (src / "a.md").unlink()
    folder(src, a2="new note")
    third = c.build(now=datetime(2024, 1, 2))
    assert third.published and third.compiled == 3 and third.reused == 0 and third.tombstones == 1
    folder(src, e="epsilon")
    fourth = c.build()
    assert (fourth.compiled, fourth.reused) == (1, 3)
    other = compiler.Compiler(spark, "s", str(src), store, settings.BuildPolicy.merged({"chunk": 300}))
    assert other.policy_hash != c.policy_hash and other.build().reused == 0
    calls = []

    def moving():
        calls.append(1)
        folder(src, f=f"changes {len(calls)}")
        return compiler.markdown.scan(spark, str(src))

    with pytest.raises(compiler.SourceChanged):
        compiler.Compiler(spark, "s", str(src), store, read=moving).build()
    assert c.journal.verify()
    with pytest.raises(ValueError):
        compiler.Compiler(spark, "s", str(src), Store(spark, f"file://{src}/out"))


def test_many_sources_are_served_together(spark, tmp_path):
    made = []
    for name in ("one", "two"):
        folder(tmp_path / name, a=f"# Head\nwords of {name} in a note")
        made.append(compiler.Compiler(spark, name, str(tmp_path / name), Store(spark, f"file://{tmp_path}/out-{name}")))
    runtime = compiler.RuntimeCatalog(spark, f"file://{tmp_path}/runtime")
    assert runtime.read() == (None, None)
    reports, checksum = compiler.build_all(made, runtime)
    assert set(runtime.read()[1]["pins"]) == {"one", "two"}
    pins = {s: r.generation for s, r in reports.items()}
    assert runtime.publish(pins, "whatever", "tessera") == checksum  # the same again
    with pytest.raises(Conflict):
        runtime.publish({"one": pins["one"]}, "stale", "tessera")
    with pytest.raises(PermissionError):
        runtime.publish({"one": pins["one"]}, checksum, "somebody else")
    with pytest.raises(ValueError):
        runtime.read({"dims": 5})
    served = compiler.Served({c.source: c.store for c in made}, runtime, lambda sources: search.union_records(sources))
    assert served.reload() and not served.reload()
    assert {r["source_id"] for r in served.engine.collect()} == {"one", "two"}


def test_snapshots(spark, tmp_path):
    store, made = Store(spark, f"file://{tmp_path}/snap"), []

    def make():
        made.append(1)
        return {"t": spark.range(3)}

    key = {"version": 1, "mode": "default"}
    assert [compiler.snapshot(store, key, make).status for _ in range(2)] == ["repaired", "loaded"] and len(made) == 1
    assert compiler.snapshot(store, key | {"version": 2}, make).status == "repaired"
    assert compiler.snapshot(store, {"version": 3}, make, save=False).status == "degraded"


def test_pointers_are_never_lost(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    g1 = store.publish({"t": spark.range(2)})
    g2 = store.publish({"t": spark.range(3)}, expected=g1)
    (tmp_path / "s/pointers/000000000003.json").write_text("{half")  # a writer that stopped
    assert store.current() == g2
    g3 = store.publish({"t": spark.range(4)}, expected=g2)
    assert store.current() == g3 and store.rollback() == g2 and store.prune(quarantine=True) == [g3]
    assert (tmp_path / f"s/quarantine/{g3}").exists()


def test_unions_and_contexts(spark):
    a, b = (spark.createDataFrame([(i, f"p{i}")], "id int, path string") for i in (1, 2))
    assert search.union_records({"x": a, "y": b}).count() == 2
    with pytest.raises(ValueError):
        search.union_records({"x": a, "y": a})
    v = lambda df: df.select("id", F.array(F.lit(1.0)).alias("values"))
    assert search.combine_vectors({"x": (a, v(a)), "y": (b, v(b))}).count() == 2
    assert search.combine_vectors({"x": (a, v(a)), "y": (b, None)}) is None and search.combine_vectors({"x": (a.limit(0), None)}) is None
    for bad, required in (({"x": (a, None)}, True), ({"x": (a, v(b))}, False)):
        with pytest.raises(ValueError):
            search.combine_vectors(bad, required)
    found = [{"path": "a.md", "heading": "H", "content": "word " * 100}, {"path": "b.md", "content": "short"}]
    text, paths, cut = search.pack_context("q", found, 500, 100, failed=["z"])
    assert paths == ["a.md", "b.md"] and cut and len(text.encode()) <= 500 and "Partial source failures (1): z." in text
    text, paths, cut = search.pack_context("q", found, 220)
    assert cut and len(text.encode()) <= 220 and paths in (["a.md"], [])


def test_write_service(tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo\n")
    writer = writes.Writer(tmp_path, writes.Approvals(b"k"))
    seen = []
    yes = lambda r: seen.append(r) or service.Decision(r.id, r.binding, True, "ann")
    s = service.WriteService({"v": writer}, service.Broker(yes), reingest=lambda source, path: seen.append((source, path)))
    me = visibility.Principal(sources=["v"], exclude=["secret"])
    review = s.prepare("v", "a.md", "one\n2\n", "typo", me)
    assert "-two" in review.text and "+2" in review.text and review.level == "medium"
    receipt = s.commit(review.id)
    assert receipt["state"] == "visible" and seen[-1] == ("v", "a.md") and (tmp_path / "a.md").read_text() == "one\n2\n"
    with pytest.raises(PermissionError):
        s.commit(review.id)
    back = s.prepare_rollback("v", receipt, "no", me)
    assert s.commit(back.id)["state"] == "rolled back" and (tmp_path / "a.md").read_text() == "one\ntwo\n"
    for source, path, p in (("w", "a.md", me), ("v", "secret/x.md", me), ("v", ".hidden/x.md", me), ("v", "a.md", visibility.Principal(sources=["z"]))):
        with pytest.raises((ValueError, PermissionError)):
            s.prepare(source, path, "x", "r", p)
    late = s.prepare("v", "b.md", "new", "r", me, now=0.0)
    with pytest.raises(PermissionError):
        s.commit(late.id)
    full = service.WriteService({"v": writer}, service.Broker(lambda r: None), capacity=1)
    waiting = full.prepare("v", "c.md", "x", "r")
    with pytest.raises(RuntimeError):
        full.prepare("v", "d.md", "x", "r")
    with pytest.raises(PermissionError):
        full.commit(waiting.id)
    other = service.Broker(lambda r: service.Decision(r.id, "else", True, "ann"))
    with pytest.raises(PermissionError):
        other.decide(review)
    assert writer.ledger.verify()


def test_capabilities():
    server = service.offer("s", ["write.cas", "proposal.create"])
    client = {"protocol": service.PROTOCOL, "supported": ["proposal.create", "write.atomic"], "required": ["proposal.create"]}
    assert service.negotiate(client, server) == {"accepted": True, "common": ["proposal.create"], "missing": []}
    assert service.negotiate(client | {"required": ["write.cas"]}, server)["missing"] == ["write.cas"]
    assert not service.negotiate(client | {"protocol": "old"}, server)["accepted"]
    with pytest.raises(ValueError):
        service.offer("s", ["odd"])


def test_waiting_for_visibility():
    clock = iter(x / 10 for x in range(100))
    states = iter([{"state": "absent", "version": None, "searchable": False}, {"state": "present", "version": "v1", "searchable": False}, {"state": "present", "version": "v1", "searchable": True}])
    got = service.await_visible(lambda: None, lambda: next(states), "v1", clock=lambda: next(clock), sleep=lambda _: None)
    assert got.searchable and not got.timed_out and got.attempts == 3
    late = service.await_visible(lambda: None, lambda: {"state": "absent", "version": None, "searchable": False}, "v1", timeout=0.5, clock=lambda: next(clock), sleep=lambda _: None)
    assert late.timed_out and late.observed == "absent"
    assert service.await_visible(lambda: 1 / 0, dict, None).error == "ZeroDivisionError"
    odd = service.await_visible(lambda: None, lambda: {"state": "present", "version": None, "searchable": True}, "v")
    assert odd.error == "ValueError"
    with pytest.raises(ValueError):
        service.await_visible(lambda: None, dict, None, timeout=99)


def test_overview_and_faults_of_counts(spark):
    rows = spark.createDataFrame([("core", "default", None, False, 3), ("x", "never", "generated type: a", False, 0), ("core", "default", None, True, 1)], "corpus string, retrieval_scope string, reason string, duplicate boolean, chunks int")
    got = {(r["kind"], r["value"]): r["n"] for r in catalog.overview(rows).collect()}
    assert got == {("notes", "discovered"): 3, ("notes", "indexed"): 2, ("notes", "excluded"): 1, ("notes", "duplicate"): 1, ("notes", "chunks"): 4, ("corpus", "core"): 2, ("scope", "default"): 2, ("excluded", "generated type"): 1}
    assert catalog.overview(rows.limit(0)).collect() == []


@pytest.mark.parametrize("by_project", [True, False])
def test_analysis_from_documents_to_legend(spark, by_project):
    from tessera.operators import analysis

    table, _ = manifest.topics_table(spark, None)
    body = {"d": "database index query storage", "s": "code release test pipeline", "m": "experiment method sample result"}
    rows = [(f"{g}{i}", f"area-{g}/n{i}.md", f"{g} note {i}", [], [g], [f"About {g}"], f"{t} entry {i} of the {t} series", False, None) for g, t in body.items() for i in range(5)]
    rows += [("x1", "tmp/gone.md", "Gone", [], [], [], "text", False, None), ("x2", "area-d/copy.md", "Copy", [], [], [], rows[0][6], False, None), ("x3", "area-d/out.md", "Out", [], [], [], "y", True, "by hand")]
    docs = spark.createDataFrame(rows, "id string, path string, title string, aliases array<string>, tags array<string>, headings array<string>, content string, graph_exclude boolean, graph_exclude_reason string")
    links = spark.createDataFrame([(f"{g}{i}", f"{g}{(i + 1) % 5}") for g in body for i in range(5)] + [("d0", "x1")], "src string, dst string")
    got = analysis.analyse(docs, links, table, most=5, priority=["storage"], by_project=by_project)
    reasons = {r["id"]: r["reason"] for r in got.documents.collect()}
    # of two equal documents the one with the lesser id stays
    assert reasons["x1"] and reasons["x2"].startswith("duplicate of") and reasons["x3"] == "by hand" and reasons["d1"] is None
    home = {r["node"]: r["community"] for r in got.communities.collect()}
    assert set(home) == {f"{g}{i}" for g in body for i in range(5)}
    assert all(len({home[f"{g}{i}"] for i in range(5)}) == 1 for g in body) and len(set(home.values())) == 3
    hubs = {r["community"]: r["hub"] for r in got.hubs.collect()}
    assert all(home[h] == c for c, h in hubs.items()) and len(hubs) == 3
    assert {r["node"] for r in got.colors.where("color rlike '^#[0-9a-f]{6}$'").collect()} == set(home)
    assert sorted(r["size"] for r in got.legend.where("topic is null").collect()) == [5, 10]
    assert got.labels.count() == 3 and got.recommended.count() >= 1 and sum(r["size"] for r in got.clusters.collect()) == 15


def test_graph_documents_from_notes(spark):
    from tessera.sources import markdown

    text = "---\ntitle: T\ngraph_exclude: true\ngraph_exclude_reason: by hand\ngraph_primary_topic: Data\ngraph_secondary_topics: [a, b]\n---\n# Head\nbody"
    rows = {r["id"]: r for r in markdown.graph_documents(spark.createDataFrame([("a/x.md", text), ("y.md", None)], "path string, content string")).collect()}
    x, y = rows["a/x.md"], rows["y.md"]
    assert (x["title"], x["headings"], x["graph_exclude"], x["graph_exclude_reason"], x["primary"], x["others"]) == ("T", ["Head"], True, "by hand", "Data", ["a", "b"])
    assert y["title"] == "y" and not y["graph_exclude"] and y["primary"] is None


def test_host_writer_and_counts():
    class Host(dict):
        read = dict.get

        def write(self, path, text):
            self[path] = text

        delete = dict.pop

    host = Host({"a.md": "old\n"})
    w = writes.HostWriter(None, writes.Approvals(b"k"), host=host)
    p = writes.propose("a.md", "old\n", None, "gone", 0.0)
    receipt = w.commit(p, w.approvals.grant(p, 0.0), now=1.0)
    assert "a.md" not in host
    w.rollback(receipt)
    assert host["a.md"] == "old\n"
    assert settings.checked_counts({"a": 1, "b": 0}, ["a", "b"]) == {"a": 1, "b": 0}
    for bad in ({"a": 1}, {"a": -1, "b": 0}, {"a": True, "b": 0}, [1]):
        with pytest.raises(ValueError):
            settings.checked_counts(bad, ["a", "b"])
