"""Best-fit packing of tokenized documents by swap-based local search.

Documents are cut only where they exceed the capacity; full pieces fill a sequence each. The other pieces are dealt
into blocks of bounded size. A block starts from a decreasing best fit, then works on its underfull bins: it moves a
piece, or exchanges one for one or two for one, from a bin to a fuller one where that raises the sum of squared fills
and fits, so that bins empty. The search is local and bounded: ``SWEEPS`` passes over a block's underfull bins, each
of which tries its ``PARTNERS`` fullest others, and pairs among its first ``PAIRED`` pieces. Bins under 63/64 full are
dealt again in a second round with fewer blocks, so the blocks' remainders meet. No piece is ever left out; the bounds
cost sequences only (the README has the measured excess over the least possible number).

Defined cases: a null or empty text is its end mark alone; a null doc_id is kept as it is, ids of any size exactly; repeated rows are packed
one by one; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean

#: Pieces that one task packs at a time.
BLOCK_PIECES = 40_000
#: Words whose ids a worker remembers, twice: the latest and those before.
CACHE_WORDS = 400_000
ROUNDS = 2
#: Bounds of a block's local search.
SWEEPS, PARTNERS, PAIRED = 4, 64, 24

_PIECES = "doc_id long, known boolean, piece int, start long, length long, ids_crc32 long, row long"
_PLACED = "doc_id long, known boolean, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long"


class WordEncoder:
    """A tokenizer whose words, split at white space, are encoded once and remembered.

    The vocabulary drops white space and never joins what it separates, so a text's ids are its words' ids in order.
    New words are encoded together: an id that ends a pre-token marks it, and the pre-tokens of each word are counted
    (a word of letters is one). Words with letters beyond Latin-1, whose lower case may differ in length, are encoded
    one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1 + len(special), bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,"}
        # words of small letters need neither the normalizer nor the pattern
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain = plain
        self.count = regex.compile(pattern).findall
        self.space = regex.compile("[\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+").split
        self.odd = regex.compile("[\\x1c-\\x1f]").search
        self.special = sorted(special)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words of the last full cache; those met again move on

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[str], counts: list[int] | None) -> None:
        """Remember words that have ``counts`` pre-tokens each (None: one each)."""
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            chosen = self.plain if counts is None else self.tokenizer
            ids = np.array(chosen.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            n = np.ones(len(some), np.int64) if counts is None else np.array(counts[at : at + 20_000], np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if n.sum() == len(stops):
                bounds = (4 * np.append(0, stops)[np.append(0, np.cumsum(n))]).tolist()
                flat = ids.tobytes()
                self.cache.update(zip(some, map(flat.__getitem__, map(slice, bounds, bounds[1:]))))
            else:
                self.cache.update((w, self._one(w)) for w in some)

    def _learn(self, words: list[str]) -> None:
        """Remember words; those of letters, with at most a point or comma after them, by their letters in lower case."""
        if len(self.cache) + 2 * len(words) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older, marks = self.cache, self.older, self.marks
        stems, stem_of, joined = {}, [], []
        for w in words:
            if w in older:
                cache[w] = older[w]
                continue
            stem = w.lower()
            mark = stem[-1]
            if mark in marks:
                stem = stem[:-1]
            else:
                mark = ""
            if stem.isalpha() and (stem.isascii() or max(w) < "Ā"):
                if stem in older:
                    cache[stem] = older[stem]
                elif stem not in cache:
                    stems[stem] = None
                if stem != w:
                    stem_of.append((w, stem, mark))
            elif max(w) < "Ā" and not any(s in w for s in self.special):
                joined.append(w)
            else:
                cache[w] = self._one(w)
        self._together(list(stems), None)
        self._together(joined, [len(self.count(w.lower())) for w in joined])
        for w, stem, mark in stem_of:
            cache[w] = cache[stem] + marks[mark] if mark else cache[stem]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        words = [w for w in self.space(text) if w] if self.odd(text) else text.split()
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            if len(words) > CACHE_WORDS // 4:
                return self._one(text)
            before = self.cache
            self._learn(list(set(words).difference(before)))
            if self.cache is not before:  # room was made: the other words move on
                self._learn(list(set(words).difference(self.cache)))
            return b"".join(map(self.cache.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    """This worker process's encoder for a vocabulary file; it outlives the task, as this module's own names do not."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, with a checksum of their ids; ``row`` tells repeated documents apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(enc.encode(text.as_py() or "") + last, "<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, value in zip(out, (doc or 0, doc is not None, k, at, len(part), zlib.crc32(part.tobytes()), row)):
                        column.append(value)
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in _PIECES.split(", ")])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(lean(run), _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers by decreasing best fit: each item goes to the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    mask, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= n
        if free:
            room[free].append(b)
            mask |= 1 << free
    return bins


def _exchange(into: list[int], out: list[int], lengths: list[int], free: int, fill_into: int, fill_out: int) -> tuple[list[int], list[int]] | None:
    """The change of the two bins that adds most to the fuller one: (pieces that enter it, pieces that leave it)."""
    best, found = 0, None
    ordered = sorted(set(lengths[i] for i in into))
    by = {lengths[i]: i for i in into}
    have = [(lengths[i], (i,)) for i in out]
    have += [(lengths[a] + lengths[b], (a, b)) for k, a in enumerate(out[:PAIRED]) for b in out[k + 1 : PAIRED]]
    for n, items in have:
        gain = n
        if len(items) == 1 and best < gain <= free:
            best, found = gain, (list(items), [])
        for m in ordered:  # these leave the fuller bin in exchange
            gain = n - m
            if best < gain <= free:
                best, found = gain, (list(items), [by[m]])
    if found and best > 0 and (fill_into + best) ** 2 + (fill_out - best) ** 2 > fill_into**2 + fill_out**2:
        return found
    return None


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, sweeps: int = SWEEPS) -> list[list[int]]:
    """Local search over the underfull bins; each change raises the sum of squared fills, so it ends."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(sweeps):
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        changed = False
        for at, out in enumerate(open_bins):
            for into in reversed(open_bins[at + 1 :][-PARTNERS:]):  # the fullest others
                while bins[out] and fill[into] < capacity and fill[into] >= fill[out]:
                    got = _exchange(bins[into], bins[out], size, capacity - fill[into], fill[into], fill[out])
                    if not got:
                        break
                    enter, leave = got
                    bins[into] = [i for i in bins[into] if i not in leave] + enter
                    bins[out] = [i for i in bins[out] if i not in enter] + leave
                    delta = sum(size[i] for i in enter) - sum(size[i] for i in leave)
                    fill[into] += delta
                    fill[out] -= delta
                    changed = True
                if not bins[out]:
                    break
        if not changed:
            break
    return [b for b in bins if b]


def _packer(capacity: int, round_no: int):
    def pack_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "known", "doc_id", "piece", "row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(pdf))
        counts = np.array([len(b) for b in bins], np.int64)
        which = np.repeat(np.arange(len(bins)), counts)
        ends = np.cumsum(lengths[order])
        fills = np.add.reduceat(lengths[order], np.concatenate([[0], np.cumsum(counts)[:-1]])) if len(bins) else np.zeros(0, np.int64)
        first = (np.cumsum(fills) - fills)[which]
        out = pdf.iloc[order].drop(columns=["block"])
        # round, block and bin: unique among all sequences
        out["sequence_id"] = ((round_no + 1) << 58) | (int(key[0]) << 28) | which
        out["offset"] = ends - lengths[order] - first
        out["fill"] = fills[which]
        return out[[x.split()[0] for x in _PLACED.split(", ")]]

    return pack_block


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece's sequence and place there; the texts and ids themselves are not moved."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    full = pieces.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("fill"))
    todo, done = pieces.where(F.col("length") < capacity), [full]
    for r in range(ROUNDS):
        blocks = max(1, -(-todo.count() // BLOCK_PIECES))
        spread = F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(r)), F.lit(blocks)).cast("int")
        placed = scratch.save(todo.withColumn("block", spread).groupBy("block").applyInPandas(_packer(capacity, r), _PLACED), f"round{r}")
        if r == ROUNDS - 1 or blocks == 1:
            done.append(placed)
            break
        under = F.col("fill") < capacity - capacity // 64
        done.append(placed.where(~under))
        todo = placed.where(under).drop("sequence_id", "offset", "fill")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
