"""Counts of a tokenizer's tokens by a compiled finite-state transducer.

A vocabulary built by pair merging has one encoding for each text. Its last piece at each place follows from the last
pieces at earlier places: of the pieces that end there, it is the one that may stand beside the last piece of the
text before it (two pieces may be neighbours if merging their joined text gives just these two). So what a reader has to
remember is finite: for every place at which a piece that goes on may have begun, what has been read since, the last
piece before it, and how many pieces fewer there were. That is a state; reading a character gives the next state, and
the transition is annotated with the change in the number of pieces. Only the newest places can matter, since no
piece is longer than the longest one. States are compiled when they are first reached, kept in one hash table of
numbers for each Python worker, and dropped but for those in use when there are too many.

Texts are cut into chunks of equal length. All chunks of a batch are read in step, one array operation per character
of a chunk. A chunk's state map tells, for a state at its start, the state at its end and the sum of annotations. All
states agree after a border that no piece spans; before the first such border the map is taken at the state that the
chunk before ends in if it is entered at a border of its own. Maps are then composed by a prefix scan over the chunks;
where a chunk ends otherwise than supposed, the maps that this reaches are taken again, until none is. So a text
without any border gives exact counts, too.

Defined cases: null and empty texts have no tokens; characters without a piece count as their UTF-8 bytes, or as one
unknown where the vocabulary has no bytes; strings of special pieces are plain text; a null doc_id is kept; repeated
rows are rows of their own; an empty table gives an empty table. Other columns are ignored. Vocabularies with unigram
scores have no finite transducer and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, slices
from tessera.llm.pieces import SPACE, Splitter, Vocabulary, merge_symbols

#: Characters of a chunk.
CHUNK = 128
#: States that a worker keeps, at most, between batches (they may be more within one).
MOST_STATES = 400_000
#: Characters that are read in step, about, and bytes of text that are held for it.
READ, SLICE = 1 << 20, 8 << 20
_START = 0
#: Bits of a table entry: the state read from and the class of the character, the next state, the change of the count.
_CLASS_BITS, _STATE_BITS, _CHANGE_BITS = 13, 22, 6
_BIAS = 1 << (_CHANGE_BITS - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: A place that a longer piece may begin at: what was read since, the piece before it, and the pieces since.
Place = tuple[str, str | None, int]


def cut(text: str, most: int) -> Iterator[str]:
    """A text, its spaces written as in pieces, in parts of about ``most`` characters; each begins with a space that no piece holds with what is before it."""
    start = 0
    while len(text) - start > most:
        at = text.find(SPACE, start + most)
        while at > 0 and text[at - 1] == SPACE:
            at = text.find(SPACE, at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Transducer:
    """The transducer of a vocabulary, compiled as far as it was used."""

    def __init__(self, vocabulary: Vocabulary):
        if not vocabulary.merges:
            raise ValueError("only vocabularies built by pair merging have a finite transducer")
        self.rank = vocabulary.rank
        self.splitter = Splitter(vocabulary)
        self.chars = [""] + [c for c, _ in sorted(((chr(u), k) for u, k in enumerate(self.splitter.classes.tolist()) if k), key=lambda x: x[1])]
        if len(self.chars) >= 1 << _CLASS_BITS:
            raise ValueError("the vocabulary has too many characters")
        self.known = np.unique(np.array([ord(p) for p in self.rank if len(p) == 1], np.uint32))
        self.unknown_bytes = vocabulary.byte_base is not None
        self.begun = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.whole: dict[str, bool] = {}
        self.sides: dict[str, tuple] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.places: dict[Place, Place] = {}
        self._empty([(("", None, 0),)])

    def _empty(self, states: list[tuple[Place, ...]]) -> None:
        self.states = states
        self.number = {s: k for k, s in enumerate(states)}
        self.used = 0
        self.table = np.full(1 << 16, -1, np.int64)

    def stands(self, piece: str) -> bool:
        """Merging the piece's characters gives the piece."""
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = piece in self.rank and len(merge_symbols(piece, self.rank)[0]) == 1
        return found

    def neighbours(self, a: str, b: str) -> bool:
        """Merging ``a + b`` gives ``a`` and ``b``."""
        found = self.fits.get((a, b))
        if found is None:
            joined = a + b
            # nothing can cross the border if no piece spans it
            crossing = any(joined[i:j] in self.rank for i in range(len(a)) for j in range(len(a) + 1, len(joined) + 1))
            found = self.fits[a, b] = not crossing or merge_symbols(joined, self.rank)[0] == [a, b]
        return found

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The state after one more character, and the change in the number of pieces."""
        last, change, open_places = None, 0, []
        for since, before, pieces in self.states[state]:
            piece = since + char
            if last is None and self.stands(piece) and (before is None or self.neighbours(before, piece)):
                last, change = piece, pieces + 1
            if piece in self.begun:
                open_places.append((piece, before, pieces))
        if last is None:  # a character without a piece
            return _START, len(char.encode()) if self.unknown_bytes else 1
        after = [(p, b, n - change) for p, b, n in open_places] + [("", last, 0)]
        key = tuple(self.places.setdefault(x, x) for x in after)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - int(len(self.table) - 1).bit_length())).astype(np.int64)

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New transitions, one by one as places in the table depend on each other."""
        if 2 * (self.used + len(keys)) > len(self.table):
            old = self.table[self.table >= 0]
            self.table = np.full(max(4 * len(self.table), 4 << int(self.used + len(keys)).bit_length()), -1, np.int64)
            self.used = 0
            self._add(old >> (_STATE_BITS + _CHANGE_BITS), old)
        self.used += len(keys)
        mask, at, waiting = len(self.table) - 1, self._slots(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.table[at[waiting]] < 0]
            self.table[at[free]] = values[free]  # of those that want one place, one gets it
            waiting = waiting[self.table[at[waiting]] != values[waiting]]
            at[waiting] = (at[waiting] + 1) & mask

    def _compile(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        low = (1 << _CLASS_BITS) - 1
        steps = [self.step(k >> _CLASS_BITS, self.chars[k & low]) for k in keys.tolist()]
        if len(self.states) >= 1 << _STATE_BITS:
            raise MemoryError("too many states for one batch")
        after = np.array(steps, np.int64)
        self._add(keys, (keys << (_STATE_BITS + _CHANGE_BITS)) | (after[:, 0] << _CHANGE_BITS) | (after[:, 1] + _BIAS))

    def move(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the changes in the number of pieces."""
        keys = (state << _CLASS_BITS) | kind
        at = self._slots(keys)
        got = self.table[at]
        wrong = np.flatnonzero((got >> (_STATE_BITS + _CHANGE_BITS)) != keys)
        while len(wrong):
            missing = wrong[got[wrong] < 0]
            if len(missing):
                self._compile(keys[missing])
                at[wrong] = self._slots(keys[wrong])  # the table may have grown
                got[wrong] = self.table[at[wrong]]
            else:
                at[wrong] = (at[wrong] + 1) & (len(self.table) - 1)
                got[wrong] = self.table[at[wrong]]
            wrong = wrong[(got[wrong] >> (_STATE_BITS + _CHANGE_BITS)) != keys[wrong]]
        return (got >> _CHANGE_BITS) & ((1 << _STATE_BITS) - 1), (got & ((1 << _CHANGE_BITS) - 1)) - _BIAS

    def read(self, kind: np.ndarray, border: np.ndarray, first: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place ``first`` to ``stop``, all in step: the states at the end and the sums of changes."""
        size = stop - first
        order = np.argsort(-size, kind="stable")
        at, now, total = first[order], state[order].copy(), np.zeros(len(order), np.int64)
        lanes = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        for n in lanes.tolist():  # the lanes that have more to read
            here = at[:n]
            entered = np.where(border[here], _START, now[:n])
            now[:n], change = self.move(entered, kind[here])
            total[:n] += change
            at[:n] += 1
        end, sums = np.empty_like(now), np.empty_like(total)
        end[order], sums[order] = now, total
        return end, sums

    def count(self, texts: Sequence[str | None], chunk: int = CHUNK, most: int = READ) -> np.ndarray:
        """The number of tokens of each text; about ``most`` characters are read in step."""
        out = np.zeros(len(texts), np.int64)
        units: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for unit in cut(SPACE + text.replace(" ", SPACE), most) if text else ():
                units.append(unit)
                owners.append(i)
                size += len(unit)
                if size >= most:
                    np.add.at(out, owners, self._count(units, chunk))
                    units, owners, size = [], [], 0
        if units:
            np.add.at(out, owners, self._count(units, chunk))
        return out

    def _count(self, units: list[str], chunk: int) -> np.ndarray:
        if len(self.states) > MOST_STATES:
            self._empty(self.states[:1])
            self.places, self.fits = {}, {}
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(u) for u in units])
        heads = np.append(0, ends[:-1])
        split = self.splitter
        kind = split.classes[np.minimum(code, len(split.classes) - 1)]
        border = np.empty(len(code), bool)
        border[1:] = ~split.joined[kind[:-1] * np.uint32(split.n) + kind[1:]]
        border[heads] = True
        # characters that no longer piece holds: counted at once, and a border on both sides
        single = np.flatnonzero(kind == 0)
        alone = code[single]
        size = 1 + sum((alone >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000)) if self.unknown_bytes else 1
        tokens = np.bincount(np.searchsorted(ends, single, "right"), np.where(np.isin(alone, self.known), 1, size), len(units)).astype(np.int64)
        rest = np.flatnonzero(kind)
        if len(rest):
            tokens += self._chunked(kind[rest].astype(np.int64), border[rest], np.searchsorted(rest, heads), chunk)
        return tokens

    def _chunked(self, kind: np.ndarray, border: np.ndarray, begin: np.ndarray, chunk: int) -> np.ndarray:
        """The tokens of texts that begin at the places told: state maps of chunks, composed in order."""
        stops = np.append(begin[1:], len(kind))
        chunks = -(-(stops - begin) // chunk)
        owner = np.repeat(np.arange(len(begin)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        first = begin[owner] + nth * chunk
        stop = np.minimum(first + chunk, stops[owner])
        # the first border of each chunk, or its end
        places = np.append(np.flatnonzero(border), len(kind))
        opens = np.minimum(places[np.searchsorted(places, first)], stop)
        closed = opens < stop
        tail = np.where(closed, opens, first)  # what lies behind a border, or, as supposed, the whole chunk
        leaves, sums = self.read(kind, border, tail, stop, np.zeros(len(first), np.int64))
        head = np.flatnonzero(opens > first)
        entry = leaves[head - 1]  # a text's first character is a border, so no head is a text's first chunk
        ends, counts = self.read(kind, border, first[head], opens[head], entry)
        # compose: a chunk without a border ends as its head does; later maps are taken again if that is not as supposed
        total = np.where(closed, sums, 0)
        total[head] += counts
        exits = leaves.copy()
        exits[head[~closed[head]]] = ends[~closed[head]]
        supposed = np.zeros(len(first), np.int64)
        supposed[head] = entry
        while True:
            again = head[exits[head - 1] != supposed[head]]
            if not len(again):
                break
            entry = exits[again - 1]
            ends, counts = self.read(kind, border, first[again], opens[again], entry)
            total[again] = np.where(closed[again], sums[again], 0) + counts
            supposed[again] = entry
            exits[again[~closed[again]]] = ends[~closed[again]]
        return np.bincount(owner, total, len(begin)).astype(np.int64)


_MADE: dict[str, Transducer] = {}


def _transducer(path: str) -> Transducer:
    """The worker's transducer of a vocabulary file."""
    if path not in _MADE:
        _MADE[path] = Transducer(Vocabulary.load(path))
    return _MADE[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens as the vocabulary's library counts them, and over_limit. ``vocabulary`` is a file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(vocabulary)
        for batch in slices(batches, 2, SLICE):
            tokens = pa.array(machine.count(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0)).alias("n_bytes"), F.col(f"`{text_col}`").alias("text"))
    counted = own.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
