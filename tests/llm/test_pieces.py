import hashlib
import itertools
import zlib

import numpy as np
import pytest

from tessera.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "hello world", "  hello   world ", "a\nb\tc", "é ö ñandú", "ﬁ ①", "x▁y", "日本 😀 a😀b", "It's 12,345.67!? (ok)... e.g. foo.bar,baz\n\nNext. Line", "the the the", "THE Thing; that: no!",
    "unbelievable" * 9, "a" * 200, "https://www.example.com/index.html?x=1&y=2", "def f(x):\n    return x  # done", "naïve façade — “quoted” … text", "\x00 \x7f", "ciónciónmenteas argañ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library_and_decode_back(spark, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "hello world"), (3, "hello world"), (None, "null id")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, word long").repartition(3).persist()
    vocabulary = pieces.Vocabulary.load(PATH)
    assert vocabulary.merges and vocabulary.byte_base == 3
    for chars, chunk in ((pieces.BLOCK_CHARS, pieces.CHUNK_CHARS), (30, 8)):
        monkeypatch.setattr(pieces, "BLOCK_CHARS", chars)
        monkeypatch.setattr(pieces, "CHUNK_CHARS", chunk)
        got = pieces.sequences(df, vocabulary).persist()
        want = sorted(((d, library.encode(t or "")) for d, t in rows), key=repr)
        assert sorted(((r["doc_id"], list(r["ids"])) for r in got.collect()), key=repr) == want
        back = {(r["doc_id"], r["text"]) for r in pieces.decode(got, vocabulary).collect()}
        assert back == {(d, (t or "").replace("▁", " ")) for d, t in rows}
        short = {r["doc_id"]: (r["n_pieces"], r["ids_crc32"]) for r in pieces.digests(df, vocabulary).collect()}
        assert short == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want}
    assert pieces.digests(df.limit(0), vocabulary).collect() == []


def test_digests_decode_whole_texts(spark):
    texts = TEXTS + [" ".join(t or "" for t in TEXTS) * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).persist()
    got = {r["doc_id"]: (r["text_sha256"], r["round_trip"]) for r in pieces.digests(df, pieces.Vocabulary.load(PATH)).collect()}
    assert got == {i: (hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest(), True) for i, t in enumerate(texts)}


def test_ids_without_a_piece_are_decoded_as_unknown(spark):
    vocabulary = pieces.Vocabulary.of(["▁a", "b"], [10, 11], [-1.0, -2.0], None, False)
    df = spark.createDataFrame([(1, [10, 0, 11]), (2, [99]), (3, [])], "row long, ids array<int>")
    assert {r["row"]: r["text"] for r in pieces.decode(df, vocabulary).collect()} == {1: "a ⁇ b", 2: "⁇ ", 3: ""}


def test_heap_equals_the_library(library):
    vocabulary = pieces.Vocabulary.load(PATH)
    rank = {p: (s, i) for p, i, s in zip(vocabulary.pieces, vocabulary.ids, vocabulary.scores)}
    for t in TEXTS:
        for w in (t or "").replace("▁", " ").split(" "):
            if w:
                assert pieces.merge_word("▁" + w, rank, 3) == library.encode(w)


def test_viterbi_equals_all_paths(spark):
    table = {"▁": -2.0, "a": -3.0, "b": -3.5, "▁a": -2.5, "ab": -2.25, "ba": -2.0, "aba": -6.0, "▁ab": -5.5, "bb": -9.0}
    vocabulary = pieces.Vocabulary.of(list(table), list(range(10, 10 + len(table))), list(table.values()), None, False)
    inputs = ["".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)] + ["axb", "x", "xx"]

    def best(word, unknown=-19.0):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[start:k])
                    start = k
            if all(p in table or len(p) == 1 for p in parts):
                found.append((sum(table.get(p, unknown) for p in parts), parts))
        top = max(s for s, _ in found)
        return [p for s, p in found if abs(s - top) < 1e-9]

    df = spark.createDataFrame([("▁" + w,) for w in inputs], "word string")
    ids = {p: 10 + k for k, p in enumerate(table)}
    for r in pieces.encode_words(df, vocabulary).collect():
        assert list(r["ids"]) in [[ids.get(p, 0) for p in path] for path in best(r["word"])]


def test_fold_equals_merging(spark):
    """The fold over barred edges against merging one by one, over vocabularies of random merges and all short words."""
    rng = np.random.default_rng(4)
    inputs = ["".join(x) for n in range(1, 8) for x in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in inputs], "word string").repartition(4)
    for seed in range(4):
        table = {c: -1000.0 - k for k, c in enumerate("abc"[: 3 - seed % 2])}  # the last character may lack a piece
        symbols, rank = list("abc"), 0
        while rank < 14:
            pair = "".join(rng.choice(symbols, 2))
            if len(pair) <= 6 and pair not in table:
                table[pair] = float(-rank)
                symbols.append(pair)
                rank += 1
        if seed == 3:  # equal ranks, and one above its parts
            table |= {"cc": -3.0, "aab": -3.0, "bcb": -0.0}
        for base in (None, 50):
            vocabulary = pieces.Vocabulary.of(list(table), list(range(1, 1 + len(table))), list(table.values()), base, True)
            got = {r["word"]: list(r["ids"]) for r in pieces.encode_words(df, vocabulary).collect()}
            assert got == {w: pieces.merge_word(w, vocabulary.rank, base) for w in inputs}


def test_words_of_every_length(spark, library, sf):
    """Long words, words of one character over and over, and the words of the documents, against the library."""
    texts = ["ab" * n for n in (60, 64, 65, 200)] + ["the" * 3000, "é" * 500, "x" * 128, "x" * 129, " " * 40 + "y", "日本" * 100]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs).persist()
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.sequences(df, pieces.Vocabulary.load(PATH)).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"] or "") for r in df.collect()}
