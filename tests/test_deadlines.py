"""One deadline over all steps of a query, and sources that are asked at once."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.operators import visibility
from tessera.plans import search
from tests.test_operators import frame, record

SCOPE = visibility.Scope(sources=["s"])


@pytest.fixture(scope="module")
def records(spark):
    return frame(spark, [record(i, f"topic{i % 7} common words about item{i}", title=f"Item {i}") for i in range(40)]).persist()


def timed(f):
    start = time.monotonic()
    out = f()
    return out, time.monotonic() - start


def test_a_slow_reranker_cannot_hold_the_caller(records):
    engine = search.Engine(records, reranker=lambda q, rows: time.sleep(600) or [0.0] * len(rows))
    pack, took = timed(lambda: engine.query(search.Request("item33", SCOPE), deadline=0.02))
    assert pack.status == "timeout" and pack.evidence == [] and took < 0.5
    quick = search.Engine(records)
    _, whole = timed(lambda: quick.query(search.Request("item33", SCOPE), deadline=120))
    pack, took = timed(lambda: engine.query(search.Request("item33", SCOPE), deadline=whole + 2))
    assert pack.status == "timeout" and pack.evidence == [] and took < whole + 3


def test_a_late_reranker_is_no_failed_one(records):
    broken = search.Engine(records, reranker=lambda q, rows: 1 / 0)
    pack = broken.query(search.Request("item33", SCOPE), deadline=120)
    assert pack.status == "ok" and pack.failed == ["reranker"] and pack.evidence[0].id == 33


def test_a_slow_channel_is_cancelled(spark, records):
    @F.udf("double")
    def slow(i):
        if i == 3:  # a task that is cancelled may still sleep, and takes a place
            time.sleep(15)
        return 1.0

    engine = search.Engine(records, extra={"slow": lambda seen, q: seen.select("id", slow("id").alias("score"))})
    pack, took = timed(lambda: engine.query(search.Request("item33", SCOPE), deadline=3))
    assert pack.status == "timeout" and took < 5 and pack.evidence == []


def test_ids_must_be_unique(spark):
    twice = frame(spark, [record(1, "same words"), record(1, "same words again")])
    assert search.Engine(twice).query(search.Request("same", SCOPE), deadline=120).status == "source_failure"


def test_the_engine_embeds_and_gates(spark, records):
    adapter = embedding.HashAdapter(8)  # so few slots that words collide
    vectors = embedding.record_vectors(records, adapter).persist()
    engine = search.Engine(records, vectors, adapter=adapter)
    plan, failed = engine.plan(search.Request("item33", SCOPE, candidates=40), SCOPE)
    got = {r["id"]: r["channels"] for r in plan.collect()}
    assert not failed and "dense" in got[33]
    assert [i for i, c in got.items() if "dense" in c] == [33]  # others share a slot, not a word
    ungated = search.Engine(records, vectors)
    plan, _ = ungated.plan(search.Request("item33", SCOPE, candidates=40, vector=embedding.query_vector("item33", adapter)), SCOPE)
    assert sum("dense" in r["channels"] for r in plan.collect()) > 1


def rows(spark, *found):
    return spark.createDataFrame(list(found), "id string, path string, score double, confidence double")


def test_sources_are_asked_at_once_and_fail_alone(spark):
    @F.udf("double")
    def slow(x):
        time.sleep(1.5)
        return x

    def asks(name, best):
        return lambda: rows(spark, (f"{name}1", "p", best, 0.5), (f"{name}2", "p", 1.0, 0.9)).repartition(1).withColumn("score", slow("score"))

    def fails():
        raise RuntimeError("secret detail")

    # three sources that take 3 s each, and one that fails
    out, took = timed(lambda: search.gather(spark, {"a": asks("a", 3.0), "b": asks("b", 4.0), "c": asks("c", 2.0), "d": fails}, limit=4, deadline=60))
    assert [r["id"] for r in out.rows] == ["b1", "a1", "c1", "a2"] and took < 9
    assert out.failures == [{"source_id": "d", "operation": "search", "code": "source_unavailable"}]


def test_a_late_source_is_left_behind(spark):
    @F.udf("double")
    def stuck(x):
        time.sleep(15)
        return x

    late = lambda: rows(spark, ("x", "p", 1.0, None)).withColumn("score", stuck("score"))
    out, took = timed(lambda: search.gather(spark, {"late": late, "b": lambda: rows(spark, ("b", "q", 1.0, None))}, deadline=6))
    assert [r["source_id"] for r in out.rows] == ["b"] and out.failures[0]["code"] == "timeout" and took < 7.5
    with pytest.raises(search.AllFailed):
        search.gather(spark, {"late": late}, deadline=0.2)
    assert search.gather(spark, {}).rows == []


def test_failed_plans_are_told_and_the_order_is_that_of_federate(spark):
    sources = {n: rows(spark, *[(f"{n}{i}", f"p{i % 2}", float(i % 3), [None, 0.2, 0.7][i % 3]) for i in range(6)]) for n in "xy"}
    ranked, _ = search.federate(sources, limit=9)
    out = search.gather(spark, {n: (lambda df=df: df) for n, df in sources.items()}, limit=9, deadline=60)
    assert [r["id"] for r in out.rows] == [r["id"] for r in ranked.collect()]
    broken = search.gather(spark, {"x": lambda: sources["x"], "y": lambda: sources["y"].select("id", F.expr("raise_error('no')").alias("score"))}, deadline=60)
    assert [f["source_id"] for f in broken.failures] == ["y"]
