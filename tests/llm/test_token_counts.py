"""Token counts against the library, and against merging over random vocabularies."""

import random

import numpy as np
import pytest

from tessera.llm import token_counts
from tessera.llm.pieces import SPACE, Vocabulary, merge_symbols

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "hello world", "  hello   world ", "a\nb\tc", "é ö ñandú", "ﬁ ①", "x▁y", "日本 😀 a😀b", "It's 12,345.67!? (ok)... e.g. foo.bar", "<s> </s> <unk> <0x41>",
    "unbelievable" * 90, "a" * 3000, "ab" * 2000, " " * 500, "=" * 777, "\x00 \x7f", "ciónciónmenteas argañ", "日本語" * 400, "-" * 100 + " " * 100 + "-" * 100,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(Vocabulary.load(PATH))


def test_table_equals_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "hello world")] * 2 + [(None, "null id"), (1 << 60, "long " * 5000)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n_tokens int, n_bytes string").repartition(3)
    got = token_counts.count_tokens(df, PATH, limit=1000)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 1000) for d, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_whole_documents_equal_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PATH).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.collect()}


@pytest.mark.parametrize("chunk, most", [(1, 1), (3, 10), (7, 1 << 20), (1000, 50)])
def test_any_cut_gives_the_same_counts(machine, library, chunk, most):
    r = random.Random(chunk)
    texts = [*TEXTS[:12], *["".join(r.choice("ab the=- ▁é日") for _ in range(r.randint(0, 200))) for _ in range(60)]]
    assert machine.count(texts, chunk, most).tolist() == [len(library.encode(t or "")) for t in texts]


def test_states_are_dropped_when_there_are_too_many(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 5)
    few = token_counts.Transducer(Vocabulary.load(PATH))
    texts = [*TEXTS, "one more text with other words"]
    assert few.count(texts, 16, 20).tolist() == [len(library.encode(t or "")) for t in texts]
    assert len(few.states) < 500


@pytest.mark.parametrize("seed", range(12))
def test_random_vocabularies_equal_merging(seed):
    """Scores with ties, and parts that come after what they make."""
    r = random.Random(seed)
    letters = [SPACE, *"abc"[: r.randint(1, 3)]]
    pieces = list(letters)
    for _ in range(r.randint(2, 25)):
        a, b = r.choice(pieces), r.choice(pieces)
        if a + b not in pieces and len(a + b) < 12 and SPACE not in (a + b).lstrip(SPACE):
            pieces.append(a + b)
    scores = [-float(k if r.random() < 0.7 else r.randint(0, 30)) for k in range(len(pieces))]
    v = Vocabulary.of(pieces, list(range(len(pieces))), scores, None, True)
    machine = token_counts.Transducer(v)
    texts = ["".join(r.choice("abc d ") for _ in range(r.randint(1, 40))) for _ in range(80)]
    want = [len(merge_symbols(SPACE + t.replace(" ", SPACE), v.rank)[0]) for t in texts]
    assert machine.count(texts, r.randint(1, 9), r.randint(1, 60)).tolist() == want


def test_unigram_scores_are_refused():
    with pytest.raises(ValueError):
        token_counts.Transducer(Vocabulary.of(["a"], [0], [-0.5], None, False))


def test_colliding_transitions_are_all_found(machine, library):
    machine.table = np.full(8, -1, np.int64)
    machine.used, machine.states, machine.number = 0, machine.states[:1], {machine.states[0]: 0}
    text = "hello hello world"
    assert machine.count([text], 4).tolist() == machine.count([text], 100).tolist() == [len(library.encode(text))]
