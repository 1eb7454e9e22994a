"""Choices one after the other, made in parallel."""

import random

import pytest

from tessera.operators import graph


def in_order(todo, votes, near):
    out = {}
    for item in sorted(todo, key=todo.get):
        tied = {}
        for i, c, w in votes:
            if i == item:
                tied[c] = tied.get(c, 0) + w
        for i, o, w in near:
            if i == item and out.get(o, -1) >= 0:
                tied[out[o]] = tied.get(out[o], 0) + w
        out[item] = min(tied, key=lambda c: (-tied[c], c), default=-1)
    return out


@pytest.mark.parametrize("seed, rounds", [(1, 1), (2, 2), (3, 99), (4, 99)])
def test_random_graphs(spark, seed, rounds):
    r = random.Random(seed)
    todo = {n: (r.randint(0, 9), n) for n in range(40)}
    pairs = [(r.randrange(40), r.randrange(40), float(r.randint(1, 4))) for _ in range(60)]
    near = [x for a, b, w in pairs if a != b for x in ((a, b, w), (b, a, w))]
    votes = [(r.randrange(40), r.randint(0, 3), float(r.randint(1, 3))) for _ in range(12)]
    t = spark.createDataFrame([(i, x) for i, x in todo.items()], "item long, turn struct<a:int,b:int>")
    got = graph.settled(t, spark.createDataFrame(votes, "item long, community int, w double"), spark.createDataFrame(near, "item long, other long, w double"), rounds)
    rows = got.collect()
    assert len(rows) == 40 and {x["item"]: x["community"] for x in rows} == in_order(todo, votes, near)


def test_nothing_to_settle(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert graph.settled(e("item long, turn long"), e("item long, community int, w double"), e("item long, other long, w double")).collect() == []


def test_projects_of_equal_weight_rank_by_degree(spark):
    # 0.2 + 0.2 + 0.2 and 0.3 + 0.3 are equal, though not as doubles; b has the greater degree
    nodes = spark.createDataFrame([(1, "a", 0.2), (2, "a", 0.2), (3, "a", 0.2), (4, "b", 0.3), (5, "b", 0.3)], "node long, project string, weight double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 9.0)], "src long, dst long, w double")
    got = {r["node"]: r["community"] for r in graph.consolidate_projects(edges, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
