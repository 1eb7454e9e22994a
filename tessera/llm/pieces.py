"""SentencePiece encoding and decoding over a relational lattice.

Texts become words: a space (written ``▁``) begins one, and so does a character that follows another as it does within
no piece. No piece spans two words, so words are encoded on their own, each distinct word once.

A block of texts asks for its distinct words, once each. The words of all blocks meet in parts; the distinct ones are
exploded into substrings of bounded length, these are equi-joined to the piece table (bounded by the vocabulary), a word's edges are grouped by the place
where they end, and a higher-order ``aggregate`` folds Viterbi over the places: the best-scored path to each, from the
best paths to the places before it. Two kinds of vocabularies use the one fold:

* those with unigram scores: a path's score is the sum of its pieces';
* those built by pair merging. A sequence of pieces is such a vocabulary's own encoding if and only if that holds for
  every two neighbours: as long as no merge crosses a border between pieces, each side merges as it would alone, so the
  first merge that crosses would be seen in the two neighbours alone. Every prefix has just one such sequence. So a step from
  one piece to the next is barred where a merge would cross, all scores are zero, and the one open path is the answer.
  What crosses is told by the lattice: a piece that merges last from ``l`` and ``r`` characters bars the border between
  them if ``l`` characters are one symbol on the left, and ``r`` characters on the right, until that piece's rank comes
  up. For both sides of a piece, the table holds the symbols it passes through and the rank that ends each.

Words over ``LONG_WORD`` characters (the fold copies its state at every place), words with a character that has no
piece, and words with a piece whose rank is not its own (runs of spaces) are encoded by a plain loop in the function
that groups the edges, with equal results. Characters without a piece become their UTF-8 bytes, or the unknown id where the vocabulary has no bytes.

Defined cases: null and empty texts have no words and no ids; a null doc_id is kept; repeated rows are rows of their
own; an empty table gives an empty table. Other columns are ignored. Blocks are told by the number of their first row,
as it is read, so input that is not a plain read of stored data is stored first; a block whose words are not those it
asked for raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, byte_codes, expand, mix, pick, split_by_part, squeeze, stored, text_parts, trim

SPACE = "▁"
UNKNOWN = " ⁇ "
LONG_WORD = 128
#: Characters that a block of texts, and a part of it that is split at a time, holds about.
BLOCK_CHARS = 1 << 23
CHUNK_CHARS = 1 << 19
#: Questions for one word, and answers to blocks, that are held at a time.
ASKED = 1 << 16
#: Bytes of text whose words' questions are answered together, and how many such parts a task has.
PART_BYTES, TASK_PARTS = 4 << 20, 4
_KEY = 64
_NEVER = 1 << 30
_NO_ID = -(1 << 63)
_BYTES, _PLACES = byte_codes(9), np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; ``merges`` tells pair merging from unigram scores."""

    pieces: Sequence[str]
    ids: Sequence[int]
    scores: Sequence[float]
    byte_base: int | None
    merges: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        base = next((i for i in range(n) if p.is_byte(i)), None)
        scores = [p.get_score(i) for i in plain]
        # merge ranks are whole negative numbers, log probabilities are not
        return cls.of([p.id_to_piece(i) for i in plain], plain, scores, base, all(float(s).is_integer() for s in scores))

    @classmethod
    def of(cls, pieces: Sequence[str], ids: Sequence[int], scores: Sequence[float], byte_base: int | None, merges: bool) -> Vocabulary:
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans words")
        if max(map(len, pieces), default=0) >= _KEY or len(pieces) > 1 << 20:
            raise ValueError("the vocabulary is too large to broadcast")
        return cls(pieces, ids, scores, byte_base, merges)

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def rank(self) -> dict[str, tuple[float, int]]:
        """Score and id by piece."""
        return {p: (s, i) for p, i, s in zip(self.pieces, self.ids, self.scores)}

    def unknown(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [0] if self.byte_base is None else [self.byte_base + b for b in char.encode()]


@dataclass(frozen=True)
class Edges:
    """The pieces that may be edges of a lattice, by number: text, id, score, and what merging them passes through.

    ``split`` is the length of the left part of a piece's last merge (0: a character), ``order`` its rank, ``left`` and
    ``right`` the rank that ends the symbol of each length at its left and right side (-1: there is no such symbol),
    ``odd`` tells that ranks do not decide for it.
    """

    text: list[str]
    ids: np.ndarray
    score: np.ndarray
    split: np.ndarray
    order: np.ndarray
    odd: np.ndarray
    left: list[list[int]]
    right: list[list[int]]

    @classmethod
    def of(cls, v: Vocabulary) -> Edges:
        if not v.merges:
            none = np.zeros(len(v.pieces), np.int64)
            return cls(list(v.pieces), np.array(v.ids, np.int64), np.array(v.scores, np.float64), none, none, none.astype(bool), [[]] * len(none), [[]] * len(none))
        place = {s: k for k, s in enumerate(sorted({-s for s in v.scores}))}
        long = [p for p in v.pieces if len(p) > 1]
        alike: dict[float, int] = {}
        for p in long:
            alike[v.rank[p][0]] = alike.get(v.rank[p][0], 0) + 1
        order = lambda p: place[-v.rank[p][0]]
        left: dict[str, list[int]] = {}
        right: dict[str, list[int]] = {}
        sides = lambda p, d: d.get(p, [_NEVER])
        rows = []
        for p in sorted(v.pieces, key=len):
            if len(p) == 1:
                rows.append((p, 0, 0, False))
                continue
            symbols, last = merge_symbols(p, v.rank)
            if len(symbols) > 1:
                continue  # merging never makes this piece
            a, b = last
            r = order(p)
            grow = lambda part, d: [*sides(part, d)[:-1], r, *[-1] * (len(p) - len(part) - 1), _NEVER]
            left[p], right[p] = grow(a, left), grow(b, right)
            odd = alike[v.rank[p][0]] > 1 or any(len(x) > 1 and order(x) >= r for x in (a, b))
            rows.append((p, len(a), r, odd))
        text = [x[0] for x in rows]
        split, rank, odd = (np.array([x[k] for x in rows]) for k in (1, 2, 3))
        ids = np.array([v.rank[p][1] for p in text], np.int64)
        return cls(text, ids, np.zeros(len(rows)), split.astype(np.int64), rank.astype(np.int64), odd.astype(bool), [sides(p, left) for p in text], [sides(p, right) for p in text])


def merge_symbols(word: str, rank: dict[str, tuple[float, int]]) -> tuple[list[str], tuple[str, str] | None]:
    """What is left of a word after all merges, made with a heap, and the two sides of the last merge."""
    symbols: list[str | None] = list(word)
    left, right = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    heap: list[tuple[float, int, str]] = []
    last = None

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and symbols[i] + symbols[j] in rank:
            heapq.heappush(heap, (-rank[symbols[i] + symbols[j]][0], i, symbols[i] + symbols[j]))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if symbols[i] is not None else -1
        if j < 0 or symbols[i] + symbols[j] != pair:
            continue
        last = (symbols[i], symbols[j])
        symbols[i], symbols[j], right[i] = pair, None, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [s for s in symbols if s is not None], last


def merge_word(word: str, rank: dict[str, tuple[float, int]], byte_base: int | None, unknown_id: int = 0) -> list[int]:
    """Ids of one word by merging."""
    out: list[int] = []
    for s in merge_symbols(word, rank)[0]:
        out += [rank[s][1]] if s in rank else [unknown_id] if byte_base is None else [byte_base + b for b in s.encode()]
    return out


def best_path(word: str, v: Vocabulary, unknown: float) -> list[int]:
    """Ids of the best-scored path through one word; ties go to the longer last piece."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        steps = []
        for k in range(1, min(e, v.longest) + 1):
            found = v.rank.get(word[e - k : e])
            if found or k == 1:
                steps.append((best[e - k][0] + (found[0] if found else unknown), k))
        best.append(max(steps))
    out: list[list[int]] = []
    e = len(word)
    while e:
        k = best[e][1]
        found = v.rank.get(word[e - k : e])
        out.append([found[1]] if found else v.unknown(word[e - k : e]))
        e -= k
    return [i for ids in reversed(out) for i in ids]


class Splitter:
    """Cuts texts into words: between documents, and between characters that are neighbours in no piece."""

    def __init__(self, vocabulary: Vocabulary):
        pairs = {p[i : i + 2] for p in vocabulary.pieces for i in range(len(p) - 1)}
        chars = sorted({c for p in pairs for c in p})
        self.classes = np.zeros(max(map(ord, [SPACE, *chars])) + 2, np.uint32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n = len(chars) + 1
        self.joined = np.zeros(self.n * self.n, bool)
        number = {c: k for k, c in enumerate(chars, 1)}
        self.joined[[number[p[0]] * self.n + number[p[1]] for p in pairs]] = True

    def split(self, texts: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All words of texts (none empty), the words of each, and how many spaces begin a word in each."""
        joined = "".join([SPACE + t for t in texts]).replace(" ", SPACE)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stop = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        kind = self.classes[np.minimum(code, len(self.classes) - 1)]
        cut = np.empty(len(code), bool)
        cut[1:] = ~self.joined[kind[:-1] * np.uint32(self.n) + kind[1:]]
        cut[np.append(0, stop[:-1])] = True
        first = np.flatnonzero(cut)
        raw = joined.encode()
        if len(raw) == len(code):
            offsets = np.append(first, len(raw))
        else:
            size = (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000) + 1
            offsets = np.append(np.append(0, np.cumsum(size, dtype=np.int64))[first], len(raw))
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
        space = code == ord(SPACE)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[np.append(0, stop[:-1])] = True
        counts = np.diff(np.append(0, np.searchsorted(first, stop)))
        return words, counts, np.add.reduceat(begins, np.append(0, stop[:-1]), dtype=np.int64)


class Block:
    """Some texts as numbers of their distinct words; frequent words have small numbers."""

    def __init__(self):
        self.doc: list[int] = []
        self.row: list[int] = []
        self.counts: list[int] = []
        self.begins: list[int] = []
        self.own: list[bytes] = []
        self.chunks: list[pa.Array] = []
        self.chars = 0

    def words(self) -> tuple[pa.Array, list[np.ndarray]]:
        if not self.chunks:
            return pa.array([], pa.large_string()), []
        whole = pa.chunked_array(self.chunks).unify_dictionaries()
        words = whole.chunk(0).dictionary
        codes = [c.indices.to_numpy() for c in whole.chunks]
        order = np.argsort(-sum(np.bincount(c, minlength=len(words)) for c in codes), kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        return words.take(pa.array(order)), [number[c] for c in codes]


def _blocks(splitter: Splitter, batches: Iterator[pa.RecordBatch], hashed: bool, sizes: tuple[int, int]) -> Iterator[Block]:
    """Blocks of rows (doc, row, text) in their order; ``sizes``: about how many characters a block, and a chunk of it, has."""
    block, waiting, size = Block(), [], 0

    def flush() -> None:
        nonlocal waiting, size
        texts = [t for t in waiting if t]
        if texts:
            words, counts, begins = splitter.split(texts)
            block.chunks.append(words.dictionary_encode())
            found, started = iter(counts.tolist()), iter(begins.tolist())
        for t in waiting:
            block.counts.append(next(found) if t else 0)
            block.begins.append(next(started) if t else 0)
        waiting, size = [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                t = text.as_py() or ""
                block.doc.append(_NO_ID if doc is None else doc)
                block.row.append(row)
                if hashed:
                    block.own.append(hashlib.sha256(t.replace(SPACE, " ").encode()).digest())
                waiting.append(t)
                size += len(t) + 1
                block.chars += len(t) + 1
                if size >= sizes[1]:
                    flush()
                if block.chars >= sizes[0]:
                    flush()
                    yield block
                    block = Block()
    if block.row:
        flush()
        yield block


def _word_parts(words: pa.Array, n: int) -> np.ndarray:
    """The part, of ``n``, of each word (none empty)."""
    offsets, raw = np.frombuffer(words.buffers()[1], np.int64), np.frombuffer(words.buffers()[2], np.uint8)
    offsets = offsets[words.offset : words.offset + len(words) + 1]
    size = np.diff(offsets)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
    weighed = _BYTES[raw[offsets[0] : offsets[-1]]] * _PLACES[np.minimum(place, len(_PLACES) - 1)]
    return (mix(np.add.reduceat(weighed, offsets[:-1] - offsets[0])) % np.uint64(n)).astype(np.int64)


def _asked(splitter: Splitter, sizes: tuple[int, int], n: int):
    """The distinct words of each block, dealt into ``n`` parts by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(splitter, batches, False, sizes):
            words, _ = block.words()
            if not len(words):
                continue
            order, bounds = split_by_part(_word_parts(words, n), n)
            data = []
            found = np.flatnonzero(np.diff(bounds))
            for p in found.tolist():
                o = order[bounds[p] : bounds[p + 1]]
                some = words.take(pa.array(o))
                size = np.diff(np.frombuffer(some.buffers()[1], np.int64)[: len(o) + 1])
                data.append(squeeze(np.array([block.row[0]]), np.diff(o, prepend=0).astype(np.uint32), size.astype(np.uint32), np.frombuffer(some.buffers()[2], np.uint8)[: int(size.sum())]))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])
        trim()

    return run


def _coded(splitter: Splitter, sizes: tuple[int, int]):
    """block and its texts as numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(splitter, batches, True, sizes):
            words, codes = block.words()
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            # low and high bytes apart: the high ones of frequent words are zero
            planes = np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            data = squeeze(np.array(block.doc, np.int64), np.array(block.row, np.int64), np.array(block.counts, np.int64), np.array(block.begins, np.int64), np.frombuffer(b"".join(block.own), np.uint8), np.array([len(words)]), planes)
            yield pa.RecordBatch.from_arrays([pa.array([block.row[0]], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])
        trim()

    return run


_LATTICE = (
    "word string, done array<int>, places array<array<struct<k: int, score: double, left: array<int>, right: array<int>, id: int>>>, "
    "bars array<array<struct<l: int, r: int, rank: int>>>"
)


def _nested(outer: np.ndarray, inner: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(outer)), pa.int32()), inner)


def _lattices(vocabulary: Vocabulary, edges: Edges, carry: int):
    """Groups the joined rows (word, carried columns, at, k, piece) of each word, which follow one another; a word's first has k = 0.

    The join's other side is broadcast, so its rows stay in the order of the words they come from; a row whose edge
    does not lie within the word before it raises an error.
    """
    unknown = 0.0 if vocabulary.merges else min(vocabulary.scores, default=0.0) - 10.0

    def emit(word: list[str], carried: list[pa.Array], own: np.ndarray, at: np.ndarray, k: np.ndarray, piece: np.ndarray) -> pa.RecordBatch:
        size = np.array([len(w) for w in word], np.int64)
        if len(at) and (np.any(at + k > size[own]) or np.any(at < 0)):
            raise ValueError("the edges of words did not stay together")
        # a character without a piece has no edge: those words, long and odd ones are done here
        plain = (size > LONG_WORD) | (np.bincount(own[k == 1], minlength=len(word)) < size)
        plain[own[edges.odd[piece]]] = True
        done = [None if not p else merge_word(w, vocabulary.rank, vocabulary.byte_base) if vocabulary.merges else best_path(w, vocabulary, unknown) for w, p in zip(word, plain.tolist())]
        fold = np.where(plain, 0, size)
        keep = ~plain[own]
        own, at, k, piece = own[keep], at[keep], k[keep], piece[keep]
        base, total = np.cumsum(fold) - fold, int(fold.sum())
        end = base[own] + at + k - 1
        # ends of a word within its places; longer edges first
        order = np.lexsort((-k, end))
        taken = pa.array(piece[order])
        edge = pa.StructArray.from_arrays([pa.array(k[order], pa.int32()), pa.array(edges.score[piece[order]]), left_of.take(taken), right_of.take(taken), pa.array(edges.ids[piece[order]], pa.int32())], names=["k", "score", "left", "right", "id"])
        places = _nested(fold, _nested(np.bincount(end, minlength=total), edge))
        split = edges.split[piece]
        merged = split > 0
        border = (base[own] + at)[merged] + split[merged]
        by = np.argsort(border, kind="stable")
        ints = lambda x: pa.array(x[merged][by], pa.int32())
        bar = pa.StructArray.from_arrays([ints(split), ints(k - split), ints(edges.order[piece])], names=["l", "r", "rank"])
        bars = _nested(fold, _nested(np.bincount(border, minlength=total), bar))
        names = ["word", *[f"carry_{i}" for i in range(carry)], "done", "places", "bars"]
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), *carried, pa.array(done, pa.list_(pa.int32())), places, bars], names=names)

    as_lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    left_of, right_of = as_lists(edges.left), as_lists(edges.right)

    def group(rows: pa.Table) -> pa.RecordBatch:
        at, k, piece = (rows.column(1 + carry + c).to_numpy().astype(np.int64) for c in range(3))
        head = k == 0
        if not head[0]:
            raise ValueError("the edges of words did not stay together")
        own = np.cumsum(head) - 1
        first = rows.filter(pa.array(head)).combine_chunks()
        plain = lambda c: pa.concat_arrays(c.chunks)
        return emit(first.column(0).to_pylist(), [plain(first.column(1 + c)) for c in range(carry)], own[~head], at[~head], k[~head], piece[~head])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:  # the last word's edges may go on in the next batch
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            heads = np.flatnonzero(rest.column(2 + carry).to_numpy() == 0)
            if len(heads) > 1:
                yield group(rest.slice(0, int(heads[-1])))
                rest = rest.slice(int(heads[-1]))
        if rest is not None and rest.num_rows:
            yield group(rest)
        trim()

    return run


def fold_viterbi(places: Column, bars: Column) -> Column:
    """Ids of the best-scored open path; ``places`` holds the edges that end at each place, ``bars`` the merges that cross it."""
    state = "array<struct<total: double, k: int, right: array<int>, ids: array<int>>>"

    def step(paths: Column, here: Column) -> Column:
        end = F.size(paths) + 1

        def is_open(edge: Column) -> Column:
            start = end - edge["k"]
            crosses = lambda bar: (F.get(edge["left"], bar["r"] - 1) >= bar["rank"]) & (F.get(F.get(paths, start - 1)["right"], bar["l"] - 1) > bar["rank"])
            return ~F.coalesce(F.exists(F.get(bars, start), crosses), F.lit(False))

        def follow(edge: Column) -> Column:
            before = F.get(paths, end - edge["k"] - 1)
            ids = F.concat(F.coalesce(before["ids"], F.array().cast("array<int>")), F.array(edge["id"]))
            return F.struct((F.coalesce(before["total"], F.lit(0.0)) + edge["score"]).alias("total"), edge["k"].alias("k"), edge["right"].alias("right"), ids.alias("ids"))

        return F.concat(paths, F.array(F.array_max(F.transform(F.filter(here, is_open), follow))))

    return F.aggregate(places, F.array().cast(state), step, lambda paths: F.element_at(paths, -1)["ids"])


def encode_words(distinct: DataFrame, vocabulary: Vocabulary, *carry: str) -> DataFrame:
    """word, carried columns and ids of a table of distinct words (column ``word``); work stays in the partitions of the words."""
    spark = distinct.sparkSession
    edges = Edges.of(vocabulary)
    table = spark.createDataFrame(pd.DataFrame({"text": ["", *edges.text], "piece": np.arange(-1, len(edges.text))}), "text string, piece int")
    n, at, k = F.length("word"), F.col("at"), F.col("k")
    longest = max(map(len, edges.text), default=1)
    # every word meets the empty piece first (at = -1): that row carries the word itself
    starts = F.when(n.between(1, LONG_WORD), F.sequence(F.lit(-1), n - 1)).otherwise(F.array(F.lit(-1)))
    lengths = F.when(at < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.least(n - at, F.lit(longest))))
    names = [f"carry_{i}" for i in range(len(carry))]
    spread = distinct.select("word", *[F.col(c).alias(a) for c, a in zip(carry, names)], F.explode(starts).alias("at")).select("*", F.explode(lengths).alias("k"))
    spread = spread.select(*[F.when(k == 0, F.col(c)).alias(c) for c in ("word", *names)], "at", "k", F.substring(F.col("word"), at + 1, k).alias("text"))
    joined = spread.join(F.broadcast(table), "text").select("word", *names, "at", "k", "piece")
    kinds = "".join(f", {a} {distinct.schema[c].dataType.simpleString()}" for c, a in zip(carry, names))
    grouped = joined.mapInArrow(_lattices(vocabulary, edges, len(carry)), _LATTICE.replace("word string", "word string" + kinds, 1))
    return grouped.select("word", *[F.col(a).alias(c) for c, a in zip(carry, names)], F.coalesce("done", fold_viterbi(F.col("places"), F.col("bars"))).alias("ids"))


def _spelling(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each id; the last entry is that of ids without a piece."""
    top = max([*vocabulary.ids, -1 if vocabulary.byte_base is None else vocabulary.byte_base + 255], default=-1)
    spelt = [UNKNOWN.encode()] * (top + 2)
    for i, p in zip(vocabulary.ids, vocabulary.pieces):
        spelt[i] = p.replace(SPACE, " ").encode()
    if vocabulary.byte_base is not None:
        spelt[vocabulary.byte_base : vocabulary.byte_base + 256] = [bytes([b]) for b in range(256)]
    return spelt


def _spell(spelt: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
    """The bytes of each text, whose ids lie between two bounds, without the space that begins it."""
    unknown = len(spelt) - 1
    ids = np.where((ids < 0) | (ids >= unknown), unknown, ids)
    _, offsets, data = spelt.take(pa.array(ids, pa.int64())).buffers()
    at = np.frombuffer(offsets, np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
    raw = data.to_pybytes() if data is not None else b""
    for x, y in zip(at, at[1:]):
        yield raw[x + (raw[x : x + 1] == b" ") : y]


_ASKS = "word string, blocks array<long>, places array<int>"


def _asks(rows: pa.Table) -> pa.Table:
    """Each distinct word of a part with the blocks that ask for it; over ``ASKED`` of them come in several rows."""
    blocks, places, sizes, raw = [], [], [], []
    for data in rows.column("data").to_pylist():
        (block,), step, size, body = expand(data)
        blocks.append(np.full(len(step), block))
        places.append(np.cumsum(step.astype(np.int64)))
        sizes.append(size)
        raw.append(body)
    block, place, size, body = (np.concatenate(x) for x in (blocks, places, sizes, raw))
    offsets = np.append(0, np.cumsum(size, dtype=np.int64))
    word = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
    code = word.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    within = np.arange(len(code)) - np.searchsorted(code, code)
    cut = np.flatnonzero(within % ASKED == 0)
    bounds = pa.array(np.append(cut, len(code)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order], t)) for x, t in ((block, pa.int64()), (place, pa.int32()))]
    trim()
    return pa.table([word.dictionary.take(pa.array(code[cut])).cast(pa.string()), *lists], names=["word", "blocks", "places"])


_TOLD = "block long, places binary, sizes binary, ids binary"


def _told(vocabulary: Vocabulary):
    """What each block asked for: places (as steps), how many ids the word at each has, and these."""
    kind = "<u2" if max([*vocabulary.ids, (vocabulary.byte_base or 0) + 255]) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, waiting = [], 0
        for batch in batches:
            some.append(batch)
            waiting += len(batch.column(0).flatten())
            if waiting >= ASKED:
                yield pack(some)
                some, waiting = [], 0
        if waiting:
            yield pack(some)
        trim()

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        blocks, places, ids = (pa.concat_arrays([b.column(c) for b in batches]) for c in range(3))
        asks = blocks.value_lengths().to_numpy(zero_copy_only=False)
        size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(asks)), asks)
        block, place = (x.flatten().to_numpy(zero_copy_only=False) for x in (blocks, places))
        order = np.lexsort((place, block))
        block, place, word = block[order], place[order], word[order]
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        step = np.diff(place, prepend=0)
        step[cut] = place[cut]
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(kind)
        start, own = np.cumsum(size) - size, size[word]
        reach = np.cumsum(own)
        told = flat[np.repeat(start[word] - (reach - own), own) + np.arange(int(own.sum()))]
        stop = np.append(cut, len(block))
        column = lambda x, at: pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(block[cut]), column(step.astype("<u4"), stop), column(own.astype("<u4"), stop), column(told, np.append(0, reach)[stop])], names=["block", "places", "sizes", "ids"])

    return run


_DIGESTS = "doc_id long, row long, n_words long, n_pieces long, ids_crc32 long, text_sha256 string, round_trip boolean"
_SEQUENCES = "doc_id long, row long, ids array<int>"


def _answer(vocabulary: Vocabulary, digest: bool):
    """Per block: its texts' ids, from the ids of its words; or what :func:`digests` tells of them."""
    spelling = _spelling(vocabulary) if digest else []
    kind = "<u2" if max([*vocabulary.ids, (vocabulary.byte_base or 0) + 255]) < 1 << 16 else "<u4"

    def run(coded: pa.Table, told: pa.Table) -> pa.Table:
        found = []
        spelt = pa.array(spelling, pa.large_binary())
        column = lambda c, k: [np.frombuffer(x, k).astype(np.int64) for x in told.column(c).to_pylist()] or [np.zeros(0, np.int64)]
        place = np.concatenate([np.cumsum(x) for x in column("places", "<u4")])
        own, flat = np.concatenate(column("sizes", "<u4")), np.concatenate(column("ids", kind)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        size, start = own[order], (np.cumsum(own) - own)[order]
        for data in coded.column("data").to_pylist():
            doc, row, counts, begins, own_sha, (n,), planes = expand(data)
            if n != len(size) or not np.array_equal(place[order], np.arange(n)):
                raise ValueError("a block's words changed between two reads: the source must be stored data")
            code = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
            stop = np.cumsum(counts)
            a = 0
            while a < len(doc):  # some texts at a time
                first = int(stop[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(stop, first + CHUNK_CHARS // 2)))
                c = code[first : int(stop[b - 1])]
                k = size[c]
                reach = np.cumsum(k)
                ids = flat[np.repeat(start[c] - (reach - k), k) + np.arange(int(k.sum()))]
                bounds = np.append(0, reach)[np.append(0, stop[a:b] - first)]
                null = np.asarray(doc[a:b] == _NO_ID)
                columns = [pa.array(doc[a:b], mask=null), pa.array(row[a:b])]
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
                    texts = [t.decode("utf-8", "replace").encode() for t in _spell(spelt, ids, bounds)]
                    sha = [hashlib.sha256(t).digest() for t in texts]
                    same = [d == own_sha[32 * i : 32 * i + 32].tobytes() for i, d in zip(range(a, b), sha)]
                    columns += [pa.array(begins[a:b]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([d.hex() for d in sha]), pa.array(same)]
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))
                found.append(pa.table(columns, names=names))
                a = b
        trim()
        return pa.concat_tables(found) if found else empty

    names = [x.split()[0] for x in (_DIGESTS if digest else _SEQUENCES).split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] if digest else [pa.int64(), pa.int64(), pa.list_(pa.int32())]
    empty = pa.table([pa.array([], t) for t in kinds], names=names)
    return run


def _encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, digest: bool) -> DataFrame:
    docs = stored(pick(docs, id_col, text_col), Scratch(docs.sparkSession, "pieces"))
    n = text_parts(docs, text_col, PART_BYTES)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    splitter, sizes = Splitter(vocabulary), (BLOCK_CHARS, CHUNK_CHARS)
    asked = rows.mapInArrow(_asked(splitter, sizes, n), "part int, data binary").repartition(-(-n // TASK_PARTS), "part")
    distinct = asked.groupBy("part").applyInArrow(_asks, _ASKS)
    told = encode_words(distinct, vocabulary, "blocks", "places").select("blocks", "places", "ids").mapInArrow(_told(vocabulary), _TOLD)
    coded = rows.mapInArrow(_coded(splitter, sizes), "block long, data binary")
    return coded.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_answer(vocabulary, digest), _DIGESTS if digest else _SEQUENCES)


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (spaces that begin a word), n_pieces, the CRC-32 of a text's ids (little-endian, 32 bits), the
    SHA-256 of the text that these ids decode to, and whether that is the text itself (its ``▁`` as spaces)."""
    return _encoded(docs, vocabulary, id_col, text_col, True).drop("row")


def sequences(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, ids): whole id sequences."""
    return _encoded(docs, vocabulary, id_col, text_col, False)


def decode(sequenced: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``text`` to (ids, ...): the bytes of a text's pieces, end to end. An id without a piece is written `` ⁇ ``."""
    spelling = _spelling(vocabulary)

    @F.arrow_udf("string")
    def joined(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        texts = _spell(pa.array(spelling, pa.large_binary()), flat, bounds)
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())

    return sequenced.withColumn("text", joined("ids"))


__all__ = ["Vocabulary", "decode", "digests", "sequences", "encode_words", "merge_word", "best_path"]
