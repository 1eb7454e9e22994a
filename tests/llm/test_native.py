import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import chat, quality, queries, sharding, url_filter


def judge(spark, urls, rules, **k):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, queries.url_rules(spark, rules), **k).collect()}


def test_url_rules(spark):
    urls = [None, "", "no scheme.com/", "https://WWW.Example.COM/en/a?b#c", "http://example.com/en/", "http://a.example.com/en", "http://notexample.com/en/x", "x://b.net/es/1", "x://net/fr/#f", "x://org", "http://com", "http://a.com/", "y://c?://d.com/"]
    got = judge(spark, urls, queries.URL_RULES)
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5] == ("a.example.com", "/en", "com/", "allow") and got[6][2:] == ("com/", "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8] == ("net", "/fr/", "net/fr/", "block")
    assert got[9] == ("org", "", None, "allow") and got[10] == ("com", "", None, "allow") and got[11][2] == "com/" and got[12] == ("c", "", None, "allow")
    assert judge(spark, ["http://a.com/"], [("b.com", "/", "block")], default="unknown")[0][2:] == (None, "unknown")
    long = "http://" + "a." * 3000 + "com/" + "x/" * 3000
    assert judge(spark, [long], queries.URL_RULES)[0][2] == "com/"
    odd = judge(spark, ["http://h.org/abc"], [("org", "/a", "block"), ("h.org", "", "allow"), ("org", "/ab", "allow")])
    assert odd[0][2:] == ("org/ab", "allow")  # the longest rule wins, and a longer host among equals
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(empty, queries.url_rules(spark, queries.URL_RULES)).collect() == []
    twice = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert url_filter.filter_urls(twice, queries.url_rules(spark, queries.URL_RULES)).count() == 3


def test_native_plans_have_no_python(spark, sf):
    for name in ("op2_url_filter", "op9_rendezvous"):
        plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_rendezvous(spark):
    rows = [(i, "text %d é" % (i % 50), i) for i in range(4000)] + [(None, None, 1), (None, "x", 1), (7, "text 7 é", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.shard_documents(df, [1.0] * 10, [1.0] * 11).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"key"}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 10)
        if r["doc_id"] is not None and r["doc_id"] != 7:
            text = ("text %d é" % (r["doc_id"] % 50)).encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(10))
    moved = sum(r["grown_shard"] == 10 for r in got)
    assert 0.06 < moved / len(got) < 0.13 and max(map(len, slots.values())) < 1.3 * len(rows) / 10
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(16, 0), (17, zlib.crc32(b"x"))}
    heavy = [r["shard"] for r in sharding.shard_documents(df, [3.0, 1.0], [3.0, 1.0, 1.0]).collect()]
    assert 0.7 < heavy.count(0) / len(heavy) < 0.8
    assert sharding.shard_documents(df.limit(0), [1.0], [1.0, 1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_documents(df, [0.0], [1.0])


def test_chat_rotation(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURN_RANGE", 2)
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 3, None, "who?"), (2, 0, "system", "alone"), (None, None, "ann", "lost"), (1, 5, "ann", "Bye"), (1, -1000, "system", "early"), (1, None, "system", "first"), (1, 4, "bob", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, mask int").repartition(4)
    got = chat.rotate(df).collect()
    people = {(r["conv_id"], r["perspective"]) for r in got}
    assert people == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.assemble(chat.rotate(df)).collect()}
    for key in people:
        mine = sorted((r for r in got if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["segment"])
        assert [r["segment"] for r in mine] == list(range(len(mine)))
        text = "".join(r["rendered"] for r in mine)
        assert text == whole[key]["text"]
        for r in mine:
            assert text[r["char_start"] : r["char_end"]] == r["rendered"]
            assert r["mask"] == (r["speaker"] == key[1]) and (r["loss_start"] == r["loss_end"]) == (r["mask"] == 0)
    ann = whole[1, "ann"]
    assert [ann["text"][s["start"] : s["end"]] for s in ann["spans"]] == ["Hi" + chat.END, "Bye" + chat.END]
    assert "user name=bob" in ann["text"] and ann["text"].count("user name=unknown") == 2
    assert chat.rotate(df.limit(0)).collect() == []


def corpus(n=900, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(5, 120)))
        good = i % 3 != 0
        if not good:
            w = [x + "$$$" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i % 5 < 3:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus()
    rows += [(5000, None), (5001, ""), (None, "some words here"), (5002, "word " * 200_000)]
    docs = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, score int").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1), (99999, None), (88888, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, known)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(i, q) for i, q in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.97 * len(held) and len(held) > 50
    assert got[5000]["score"] == got[5001]["score"]


@pytest.mark.parametrize("shift", [0.0, -9.0])
def test_pu_step_is_the_gradient_of_the_risk(shift):
    """Against differences of the risk, written out plainly, on both sides of the bound."""
    rng = np.random.default_rng(6)
    p, u, w, b, prior, decay = rng.standard_normal((40, 7)), rng.standard_normal((90, 7)) + (shift / 7), rng.standard_normal(7), 0.3, 0.6, 1e-3

    def parts(v):
        loss = lambda x, sign: np.mean([np.log1p(np.exp(-sign * (row @ v[:-1] + v[-1]))) for row in x])
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    at = np.append(w, b)
    assert (parts(at)[1] >= 0) == (shift == 0)
    risk = (lambda v: sum(parts(v))) if shift == 0 else (lambda v: -parts(v)[1])
    step = 1e-6
    want = [(risk(at + step * e) - risk(at - step * e)) / (2 * step) for e in np.eye(8)] + np.append(decay * w, 0)
    assert np.allclose(quality.pu_step(p, u, w, b, prior, decay), want, atol=1e-6)


@pytest.mark.parametrize("share", [0.1, 0.35, 0.8])
def test_prior_from_unlabelled_margins(share):
    rng = np.random.default_rng(3)
    free = np.where(rng.random(20_000) < share, rng.normal(1.5, 1, 20_000), rng.normal(-1.5, 1, 20_000))
    got = quality.estimate_prior(rng.normal(1.5, 1, 3000), rng.normal(-1.5, 1, 500), free, 3000 / 3500)
    assert abs(got - share) < 0.03


def test_quality_without_a_class(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fit = lambda ls: quality.fit(docs, spark.createDataFrame(ls, "doc_id long, quality int"))
    assert fit([]) == 0.5 and fit([(i, 1) for i, q in labels if q]) == 1.0 and fit([(i, 0) for i, q in labels if not q]) == 0.0
    assert quality.score(docs.limit(0), 0.5).collect() == [] and quality.keep_good(docs, 0.0).count() == 0


def test_sql_of_the_operators(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, rel = queries.queries()[name](spark, sf), con.sql(sql)
        cols = sorted(df.columns)
        at = [rel.columns.index(c) for c in cols]
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
