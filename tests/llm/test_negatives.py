"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, meta string, row int, anchor int"


def brute(rows, every=3, k=5, low=80, high=100):
    keep = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (i, a, y) in enumerate(keep):
        if i is None or i % every:
            continue
        score = [(sum(p * q for p, q in zip(a, b)), j, z) for n, (j, b, z) in enumerate(keep) if n != at]
        ranked = sorted(score, key=lambda x: (-x[0], last(x[1])))
        for p, j, z in [x for x in ranked if x[2] == y][:k]:
            fits = [x for x in ranked if x[2] != y and low * p <= 100 * x[0] <= high * p][:k]
            out += [(i, j, r, x[1], p, x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def run(spark, rows, **given):
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 3 == 0, **given)
    return sorted([tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=str)


def test_all_cases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 8)
    monkeypatch.setattr(negatives, "CHUNK_DIMS", 3)
    r = random.Random(5)
    rows = []
    for i in range(150):
        v = [r.choice([-0.5, -0.25, 0.1, 0.3, 0.5]) for _ in range(r.choice([7, 7, 7, 2, 0]))]
        rows.append((i + (i > 75) * (3 << 58) if i % 17 else None, v, r.choice([0, 0, 0, 1, 2, 77]), "x", 1, 2))
    rows += [(3, [0.5] * 7, 0, "x", 1, 2)] * 3  # repeated rows, equal scores
    rows += [(6, None, 1, "x", 1, 2), (9, [0.1], None, "x", 1, 2), (12, [None, 0.2], 1, "x", 1, 2), (15, [math.nan], 1, "x", 1, 2), (18, [math.inf, 0.1], 1, "x", 1, 2), (21, [0.0] * 7, 1, "x", 1, 2)]
    assert run(spark, rows) == brute(rows)


def test_large_components_are_exact(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK_DIMS", 1)
    r = random.Random(6)
    rows = [(i, [r.uniform(1e5, 2e6), r.uniform(1e5, 2e6), 1.0], i % 2, None, None, None) for i in range(12)]
    assert run(spark, rows) == brute(rows)


def test_products_beyond_64_bits_are_bounded():
    a = np.array([[1e18, 1.0]])
    assert negatives.product(a, -a)[0, 0] == -negatives._MOST
    assert negatives.added([np.array([[negatives._MOST]])] * 2)[0, 0] == negatives._MOST
    big = np.array([[3.0 * 2**30, 5.0]])
    assert negatives.product(big, big)[0, 0] == 9 * 2**60 - (9 * 2**60 - negatives._MOST)


def test_empty_table(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True), positives=0)


def test_query_has_the_columns(spark, sf):
    got = queries.queries()["op13_hard_negatives"](spark, sf)
    assert got.schema["rank"].dataType == T.IntegerType() and {"anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"} < set(got.columns)
