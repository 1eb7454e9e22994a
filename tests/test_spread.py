"""What steps on graphs send and hold: no more than their input, in parts of bounded size."""

import math
from collections import defaultdict

import pytest

from tessera.operators import graph
from tessera.plans import registry


def stages(spark):
    """Stages of the session so far: id to (tasks, records written to shuffles, records read from tables)."""
    store = spark.sparkContext._jsc.sc().statusStore()
    lists = spark.sparkContext._jvm.java.util
    got = store.stageList(lists.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), lists.ArrayList())
    rows = [got.apply(i) for i in range(got.size())]
    return {r.stageId(): (r.numTasks(), r.shuffleWriteRecords(), r.inputRecords()) for r in rows}


def neighbours(feats, k=10, floor=0.08):
    """The same in plain Python."""
    ids, terms = {i for i, _, _ in feats}, defaultdict(dict)
    for i, t, w in feats:
        terms[t][i] = w
    norm, dots = defaultdict(float), defaultdict(float)
    for own in terms.values():
        if len(own) < 2:
            continue
        v = {i: w * (math.log((len(ids) + 1) / (len(own) + 1)) + 1) for i, w in own.items()}
        for i in v:
            norm[i] += v[i] ** 2
        if len(own) > max(24, round(len(ids) * 0.16)):
            continue
        at, ring = sorted(v), len(own) > 48
        for p, x in enumerate(at):
            for y in [at[(p + o) % len(at)] for o in range(1, 9)] if ring else at[p + 1 :]:
                dots[min(x, y), max(x, y)] += v[x] * v[y] * (1 if ring else 2)
    near = {p: d / math.sqrt(norm[p[0]] * norm[p[1]]) for p, d in dots.items()}
    best = defaultdict(list)
    for (a, b), s in near.items():
        if s >= floor:
            best[a].append((-s, b, a))
            best[b].append((-s, b, a))
    return {(a, b): round(-s, 6) for of in best.values() for s, b, a in sorted(of)[:k]}


def test_neighbours_are_met_where_their_rows_are(spark, monkeypatch):
    feats = [(i, f"t{t}", 1.0 + (i * i * 37 + t * t * 101 + i * t) % 997 / 700) for i in range(400) for t in range(40) if (i * 5 + t * 13 + i * i * (t + 1)) % 7 == 0]
    feats += [(i, f"s{i % 90}", 2.0 + i * i % 997 / 900) for i in range(400)]
    df = spark.createDataFrame(feats, "id long, term string, w double")
    monkeypatch.setattr(graph, "BLOCK_FEATURES", 150, raising=False)
    before = set(stages(spark))
    got = {(r["src"], r["dst"]): round(r["similarity"], 6) for r in graph.semantic_edges(df).collect()}
    assert got == pytest.approx(neighbours(feats), abs=2e-6)
    assert max(n for i, (_, n, _) in stages(spark).items() if i not in before) < 3 * len(feats)  # a ring has eight pairs a row


def new_stages(spark, run):
    before = set(stages(spark))
    rows = run().collect()
    return rows, [x for i, x in stages(spark).items() if i not in before]


def test_edges_are_merged_in_parts_of_bounded_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 200, raising=False)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    _, ran = new_stages(spark, lambda: registry.queries()["edge_merge"](spark, sf))
    assert max(tasks for tasks, _, _ in ran) >= rows // 200


def test_labels_spread_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 10, raising=False)
    edges = [(a, b, float(1 + (a * b) % 3)) for a in range(40) for b in range(a + 1, 40) if (a * 7 + b * 11) % 5 == 0]
    got, ran = new_stages(spark, lambda: graph.label_propagation(spark.createDataFrame(edges, "src long, dst long, w double"), 3))
    label = {x: x for e in edges for x in e[:2]}
    for _ in range(3):
        votes = {x: {c: 1e-9} for x, c in label.items()}
        for a, b, w in edges:
            votes[a][label[b]] = votes[a].get(label[b], 0.0) + w
            votes[b][label[a]] = votes[b].get(label[a], 0.0) + w
        label = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
    assert {r["node"]: r["community"] for r in got} == label
    assert max(tasks for tasks, _, _ in ran) >= 2 * len(edges) // 10 > 24


def test_projects_settle_on_stored_edges(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    _, ran = new_stages(spark, lambda: registry.queries()["project_communities"](spark, sf))
    assert sum(read for _, _, read in ran) <= 2 * rows  # counted, then read


def test_louvain_passes_shuffle_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOUVAIN_EDGES", 100)
    monkeypatch.setattr(graph, "BLOCK_ENDS", 200)
    edges = [(f"n{a:02}", f"n{b:02}", 1.0 + (a + b) % 3) for a in range(60) for b in range(a + 1, 60) if a // 15 == b // 15 or (a * 7 + b * 11) % 13 == 0]
    edges += [("n00", "n00", 2.0), ("own", "own", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, w double").repartition(1).checkpoint()
    got, ran = new_stages(spark, lambda: graph.communities(df))
    part = {r["node"]: r["community"] for r in got}
    assert len(got) == len(part) == 61 and set(part.values()) == set(range(len(set(part.values()))))
    want = graph.modularity(*zip(*edges), graph.louvain(*zip(*edges)))
    assert graph.modularity(*zip(*edges), part) >= 0.98 * want
    assert sum(sent for _, sent, _ in ran) < 4 * len(edges)  # a pass used to send all labels


def test_moves_in_arrays_are_the_moves_of_a_block():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = np.repeat(np.arange(20, dtype=np.int32), 10)
    y, w = rng.integers(20, 60, 200).astype(np.int32), rng.integers(1, 4, 200).astype(float)
    label, k = rng.integers(0, 12, 60), rng.integers(10, 30, 60).astype(float)
    held, open_ = np.bincount(label, weights=k, minlength=12), np.arange(12) % 2 == 0
    free = ~open_[label]
    row = graph._moves_in_arrays(x, y, w, label, held, open_, free, k, 1.0, float(k.sum())).iloc[0]
    rows = [(n, label[n], k[n], held[label[n]], open_[label[n]], free[n], n < 20) for n in [*np.unique(y), *range(20)]]
    told = pd.DataFrame(rows, columns=["node", "community", "k", "held", "open", "free", "own"])
    want = graph._moves(pd.DataFrame({"src": x, "dst": y, "w": w}), told, 1.0, float(k.sum())).sort_values("node")
    assert np.frombuffer(row["own"], np.int32).tolist() == want["node"].tolist()
    assert np.frombuffer(row["goes"], np.int32).tolist() == want["community"].tolist() and want["shifts"].any() == row["shifts"]
    assert row["v"] == want["v"].sum()
