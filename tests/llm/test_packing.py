import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's don't Rock'n'roll 's", "a<|endoftext|>b <|startoftext|>", "İstanbul ª º µ ß ẞ", "éclair É ́x", "a\x1cb\x85c\xa0d", "1234 12.5 ... ., a., .a ,", "ΑΣ σς", "日本語 한국어 😀 a😀b", "don.t x. y, z.,", " 　tab\tnew\nline", "A.B. c", "ÀÉÎ. àéî, ÿ. Ÿ, Ā."]


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="aAéÉ.,'sS 1\n<|>", max_size=40))
@settings(max_examples=200, deadline=None)
def test_words_encode_as_the_whole_text(text):
    enc = packing.encoder(PATH)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_texts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    enc = packing.WordEncoder(PATH)
    for text in ODD * 2 + [" ".join(f"word{i}" for i in range(30)), " ".join("abcdefghi"), " ".join(f"x{i}" for i in range(9))]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, got, capacity):
    enc = packing.encoder(PATH)
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for doc, text in rows:
        ids = np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.setdefault((doc, k), []).append((at, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def test_pieces_places_and_fill(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "null id"), (7, "twice"), (7, "twice"), (1002, "long " * 500), ((1 << 60) + 1, "large id"), ((1 << 60) + 2, "large id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, piece int").repartition(4)
    got = packing.pack_documents(df, PATH, 64).collect()
    used, least = check(rows, got, 64)
    assert used <= least + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_blocks_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 60)
    rows = [(i, "a b c d e f g h i j k l m n o p"[: 2 * (i % 16) + 1]) for i in range(500)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 64).collect()
    used, least = check(rows, got, 64)
    assert used <= least + 3


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])
    start = [[0, 4], [1, 5], [2, 6], [3, 7], [8, 9]]  # fills 10 10 8 8 4 of 10: one bin too many
    got = packing.improve([list(b) for b in start], lengths, 10)
    assert sorted(i for b in got for i in b) == list(range(10)) and all(lengths[b].sum() <= 10 for b in got) and len(got) == 4
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 30, 400)
    first = packing.best_fit(lengths, 64)
    again = packing.improve([list(b) for b in first], lengths, 64)
    fill = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
    assert fill(again) >= fill(first) and len(again) <= len(first) and max(lengths[b].sum() for b in again) <= 64
