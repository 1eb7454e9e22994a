import re

import numpy as np

from tessera.llm import jaccard


def brute(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "x y"]
    say = lambda n: list(rng.choice(vocabulary, n))
    shared = say(30)
    rows, texts = [], []
    for i in range(140):
        t = say(rng.integers(1, 60))
        if rng.random() < 0.4:
            t = t[:8] + shared + t[8:]
        if texts and rng.random() < 0.5:
            t = list(texts[rng.integers(0, len(texts))])
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(0, len(t))] = f"n{rng.integers(0, 9)}"
        texts.append(t)
        rows.append((int(i * 7 % 1000), " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in t)))
    return rows + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE\ttwo"), (None, "one two"), (2005, "two one"), (2006, "one two"), (2006, "one two")]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.link_documents(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["component_id"] for r in got if r["n_shingles"]}) + sum(not r["n_shingles"] for r in got)


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_equals_brute_force_where_all_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "_SMALL", 4)
    check(spark, corpus(2))


def test_empty_table(spark):
    assert jaccard.link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)]))
        assert jaccard.differing_bits(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))
