import numpy as np

from tessera.llm.common import Scratch
from tessera.llm.components import components, union_find


def brute(links):
    low = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {a: m for a, m in low.items() if a != m}


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = dict(map(tuple, components(df, Scratch(spark, "test")).collect()))
    assert got == brute(links)
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty, Scratch(spark, "test")).collect() == []


def test_union_find_equals_brute_force():
    rng = np.random.default_rng(4)
    links = rng.integers(0, 90, (70, 2))
    a, b = union_find(links[:, 0], links[:, 1])
    assert dict(zip(a.tolist(), b.tolist())) == brute([tuple(map(int, x)) for x in links])
