import hashlib

import numpy as np
import pytest

from tessera.llm import suffix_dedup

W = 100


def brute(rows, width=W):
    """doc_id -> (bytes, removed, spans, digest) by a table of all windows in document order."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        edge = np.diff(np.append(False, gone).astype(int))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1, docs=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghé"), rng.integers(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    passages = [say(40) for _ in range(5)]
    line = say(14)  # under 100 bytes: common, but only repeated with its surroundings
    rows, texts = [], []
    for i in range(docs):
        t = say(rng.integers(1, 120))
        for _ in range(rng.integers(0, 3)):
            t += " " + passages[rng.integers(0, 5)] + " " + say(rng.integers(0, 9))
        if rng.random() < 0.5:
            t += " " + line + " " + say(5)
        if texts and rng.random() < 0.2:
            t = texts[rng.integers(0, len(texts))]
        if texts and rng.random() < 0.1:
            old = texts[rng.integers(0, len(texts))]
            t = old[: len(old) // 2] + "X" + old[len(old) // 2 :]
        texts.append(t)
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "a" * 700), (1003, "ab" * 400), (1004, "ab" * 60 + "c"), (1005, "short"), (None, "z" * 130), (1006, "z" * 101)]
    rows += [(1007, (say(30) + " ") * 6), (1008, texts[0] + texts[1])]
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_PIECES, 1])
def test_equals_brute_force(spark, hot):
    rows = corpus(2 if hot == 1 else 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, hot=hot).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == brute(rows)


def test_texts_of_every_period(spark):
    rng = np.random.default_rng(8)
    rows = [(n, bytes(rng.integers(33, 127, n, dtype=np.uint8)).decode() * (300 // n + 3)) for n in range(1, 101)]
    rows += [(200 + n, t) for n, t in rows if n in (68, 69, 70)]  # copies collapse to one piece
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(df).collect()) == brute(rows)


def test_long_text_is_cut_into_overlapping_parts(spark, monkeypatch):
    rows = corpus(3, 20)
    monkeypatch.setattr(suffix_dedup, "_LONG", 150)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == brute(rows)


def test_empty_repeated_rows_and_carried_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).collect() == []
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, "en", 5), (1, t, "de", 6), (2, t[:150] + "!", None, 7)], "doc_id long, text string, lang string, part int")
    got = {(r["doc_id"], r["lang"]): r for r in suffix_dedup.remove_repeats(df, keep_text=True, carry=["lang"]).collect()}
    assert got[1, "en"]["text"] == t and got[1, "de"]["text"] == "" and got[2, None]["text"] == "!"


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 300, 1])
def test_merge_orders_suffixes_without_resorting(monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, 130, dtype=np.uint8)) for _ in range(9)] + [b"a" * 120, b"a" * 121]
    string, place, block = suffix_dedup.repeated_windows(strings, 100)
    classes = {}
    for s, p, b in zip(string, place, block):
        classes.setdefault(strings[s][p : p + 100], set()).add(int(b))
    counts = {}
    for s in strings:
        for i in range(len(s) - 99):
            counts[s[i : i + 100]] = counts.get(s[i : i + 100], 0) + 1
    assert set(classes) == {w for w, c in counts.items() if c > 1}
    assert all(len(b) == 1 for b in classes.values()) and len({next(iter(b)) for b in classes.values()}) == len(classes)
