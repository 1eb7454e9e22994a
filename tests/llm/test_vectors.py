import numpy as np
import pandas as pd
import pytest

from tessera.llm import ann, vector_dedup


def link_brute(rows, t=0.93):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.asarray(np.float32(rows[k][1]), np.float64) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= t:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(n)), key=repr)


def vectors(seed, n=250, dims=20):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.standard_normal(dims)
        if out and rng.random() < 0.5:
            v = np.array(out[rng.integers(0, len(out))][1]) * rng.choice([1, 1, 3]) + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.3, 0.4])
        out.append((i * 5, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    odd = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * dims, 1), (9003, [float("nan")] * dims, 1), (9004, [None] + [1.0] * (dims - 1), 1)]
    odd += [(9005, out[0][1], None), (None, out[0][1], out[0][2]), (9006, out[0][1][:7], out[0][2]), (9007, out[0][1][:7], out[0][2]), (9008, [float("inf")] * dims, 1), (9009, [0.0, 1.0], 5)]
    return out + odd + out[:3]


@pytest.mark.parametrize("rows_a_cell", [vector_dedup.CELL_ROWS, 5])
def test_links_equal_brute_force(spark, monkeypatch, rows_a_cell):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", rows_a_cell)
    rows = vectors(rows_a_cell)
    df = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "vec_id long, embedding array<float>, label int, cell int").repartition(3)
    got = vector_dedup.link_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == link_brute(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert vector_dedup.link_vectors(df.limit(0)).collect() == []


def test_each_length_has_its_own_budget(spark):
    rows = vectors(3, 120, 20) + [(None if i is None else i + 20_000, v, l) for i, v, l in vectors(4, 120, 64)] + [(50_000, [1.0] * 1000, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = vector_dedup.link_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == link_brute(rows)


def near_brute(rows, k, every):
    dims = 20
    use = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (q, v) in enumerate(use):
        if q is not None and q % every == 0:
            d = [(float(np.sqrt(((np.float64(np.float32(w)) - np.float64(np.float32(v))) ** 2).sum())), i if i is not None else -1) for b, (i, w) in enumerate(use) if b != at]
            out.setdefault(q, []).append(sorted(d)[:k])
    return out


def test_nearest_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "PIECE_ROWS", 40)
    rows = [(i, v) for i, v, _ in vectors(9, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(df, 10, 50).collect()
    want = near_brute(rows, 10, 50)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"] if r["vec_id"] is not None else -1))
    assert set(by) == set(want)
    hits = total = 0
    for q, lists in want.items():
        if len(lists) > 1:  # repeated query rows have a result each
            continue
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        limit = lists[0][-1][0]
        hits += sum(m[1] <= limit + 1e-12 for m in mine)
        total += 10
    assert hits / total >= 0.9


def test_few_rows_give_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 5**0.5)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_nearest_isotropic_recall_and_large_ids(spark):
    """10,000 isotropic vectors, equal distances, ids beyond doubles beside a null one, columns that clash."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((10_000, 16)).astype(np.float32)
    v[5:9] = v[4]  # equal distances: ties go to the smaller id
    base = 1 << 60
    rows = [(None if i == 3 else base + i, v[i].tolist(), 1, 2) for i in range(len(v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, row int").repartition(4)
    got = {}
    for r in ann.nearest(df, 10, 200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in range(len(v)) if i != 3 and (base + i) % 200 == 0]
    assert set(got) == {base + i for i in asked}
    x, hits = v.astype(np.float64), 0
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        limit = np.sort(d)[9]
        mine = sorted(got[base + i])
        assert [m[0] for m in mine] == list(range(1, 11)) and len({m[1] for m in mine}) == 10
        assert all(abs(d[3 if m[1] is None else m[1] - base] - m[2]) < 1e-12 for m in mine)
        order = [(m[2], -1 if m[1] is None else m[1]) for m in mine]
        assert order == sorted(order)
        hits += sum(m[2] <= limit for m in mine)
    assert hits >= 0.9 * 10 * len(asked)


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(2)
    c = rng.standard_normal((300, 12))
    graph, x = ann.CentroidGraph.build(c), rng.standard_normal((400, 12))
    ids, dist = graph.search(x, 10)
    true = ann.distances(x, c)
    assert (true.argmin(1) == ids[:, 0]).mean() > 0.97
    assert np.allclose(np.take_along_axis(true, ids, 1), dist)


def test_later_rounds_return_only_what_is_near_enough(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 8)))], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "LIST_ROWS", 50)
    told = []
    for rounds in ((10_000,), (2, 8)):
        monkeypatch.setattr(ann, "ROUNDS", rounds)
        told.append(sorted(map(tuple, ann.nearest(df, 10, 100).collect())))
    assert len(told[0]) == 200 and told[0] == told[1]
    rows = pd.DataFrame({"known": True, "vec_id": range(100), "row": range(100), "v": [[float(i)] for i in range(100)]})
    asked = pd.DataFrame({"query_id": [0, 1], "query_row": [500, 501], "q": [[-0.5], [50.0]], "bound": [2.5, np.inf]})
    found = ann._scan(10)(asked, rows)
    assert found[found["query_id"] == 0]["vec_id"].tolist() == [0, 1, 2] and len(found[found["query_id"] == 1]) == 10
