"""The source audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, zero int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, k, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(found(text))
        docs[lang].update(set(found(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        prob = lambda n, size: 1 + 10**9 * (n + 1) // (size + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        p = {(s, t): prob(counts[lang, s][t], whole[s]) for s in sources for t in kept}
        q = {t: prob(sum(counts[lang, s][t] for s in sources), sum(whole.values())) for t in kept}
        for s in sources:
            pair = [(o, sum(f(p[s, t], p[o, t]) for t in kept)) for o in sources - {s}]
            term = [(t, f(p[s, t], q[t])) for t in kept if counts[lang, s][t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, k)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = [a + b for a in ("ba", "Zo", "ñé", "日本", "x") for b in ("n", "DA", "ö", "q", "k7", "ll_a")]
    rows = []
    for i in range(120):
        lang, source = r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "a", "b", "c", None, "é"])
        own = words[: 8 + 3 * (ord(source or "d") % 7)]
        rows.append((i, " ".join(r.choice(own) for _ in range(r.randint(0, 60))), lang, source, "x", 1, 2))
    rows += rows[:5]
    rows += [(None, None, "en", "a", None, None, None), (1, "", "de", "only", None, None, None), (2, "alone", "de", "two", None, None, None), (3, None, "it", "none", None, None, None)]
    rows.append((4, "long" * 30_000 + " " + "ba " * 5_000, "en", "b", None, None, None))
    return rows


@pytest.mark.parametrize("k, growth", [(3, 2), (2, 8), (200, 8)])
def test_equals_brute_force(spark, monkeypatch, k, growth):
    monkeypatch.setattr(divergence, "GROWTH", growth)
    monkeypatch.setattr(divergence, "SLICE", 2_000)
    rows = corpus(k)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), k=k)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, k, 3)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_division_in_two_steps_is_exact(spark):
    r = random.Random(1)
    pairs = [(n, n + 1 + r.randrange(1 << 40)) for n in (r.randrange(1 << r.randint(1, 46)) for _ in range(500))]
    got = spark.createDataFrame(pairs, "n long, w long").select("n", "w", divergence.probability("n", "w").alias("p")).collect()
    assert all(x.p == 1 + 10**9 * (x.n + 1) // x.w for x in got)


def test_terms_of_texts():
    texts = ["Ab1cd", "x", "Éa.B", "zz"]
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw[:-1])])
    got, text = divergence.terms(np.frombuffer(b"".join(raw), np.uint8), starts)
    assert [(x.as_py().decode(), t) for x, t in zip(got, text.tolist())] == [(w, i) for i, t in enumerate(texts) for w in found(t)]
