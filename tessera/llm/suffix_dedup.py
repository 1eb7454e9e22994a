"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if it lies in a ``width``-byte string that also starts earlier: in a document with a smaller doc_id, or
earlier in the same one. Strings are judged on the input and never cross documents.

How the suffixes are spread. Every window of ``width`` bytes belongs to the bucket of the least hash among its
32-byte strings, so equal windows meet in one bucket. A maximal run of windows of one bucket is a piece: some 35
windows that overlap, ``width - 1`` bytes longer than it has windows. Pieces are first sent as hashes only, of 128
bits. Equal pieces collapse before any text moves: the first one stands for all, and the copies' windows have all
started earlier. Buckets left with one piece that does not repeat itself are done. The other pieces' texts go to their
buckets.

In a bucket, pieces form shards by document order. Each shard's Burrows-Wheeler transform is built on its own, and
transforms are merged in pairs, up a tree, by refining their interleave (Holt and McMillan, 2014): a bit per suffix
tells its side, and each round stably re-deals the bits by the symbols that precede the suffixes, which sorts them by
``STEP`` more bytes. Block bounds are carried along (Egidi and Manzini, 2017), so after ``width / STEP`` rounds a block
is an interval of suffixes whose common prefix has ``width`` bytes: a repeated window where it holds more than one. No
suffix is compared or sorted again in the merges. That a merged transform is sorted by its first ``width`` bytes only is
enough for the next merge, which looks no further.

A bucket with over ``hot`` different pieces (a very common 32-byte string in ever new surroundings) is split by these
surroundings: its pieces are cut again, into runs of windows with one least hash in another order of the strings, and
so on for up to ``LEVELS`` orders, one after the other. Equal windows stay together, and all are compared as above.
Tasks are sized by the bytes of text: about ``PART_BYTES`` each.

Defined cases: a null or empty text has 0 bytes; a null doc_id counts as smaller than all others; rows with equal
doc_ids are ordered as they are first read, when they are numbered and stored once; an empty table gives an empty
table. Other columns are ignored unless named in ``carry`` (as strings).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ODD as _ODD
from tessera.llm.common import ODD2 as _ODD2
from tessera.llm.common import RollingHash, Scratch, byte_codes, expand, lean, mix, pick, slices, split_by_part, squeeze, text_column, text_parts

GRAM = 32
STEP = 5
#: Suffixes that are sorted at a time, where one bucket does not hold more.
UNIT = 60_000
#: Suffixes of a shard, about.
SHARD = 16_000
#: Different pieces above which a bucket is split by their surroundings, and how often.
HOT_PIECES = 50_000
LEVELS = 6
#: Bytes of text that a task deals with.
PART_BYTES = 6 << 20
_CHUNK = 1 << 18
_LONG = 1 << 19
_NULL_ID = -(1 << 63)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte strings of a text, doubled up from single bytes."""
    h, odd, n = byte_codes(3)[raw], int(_ODD), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(odd) + h[n:]
        odd, n = odd * odd % (1 << 64), n * 2
    return mix(h)


def find_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one bucket in texts that lie end to end: bucket, first window, windows, whether it may repeat itself.

    Each ``level`` has its own order of the 32-byte strings.
    """
    span = width - GRAM + 1
    if len(raw) < width:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e.copy(), e.astype(bool)
    h = gram_hashes(raw)
    if level:
        h = mix(h + np.uint64(level) * _ODD2)
    m, n = h, 1
    while n * 2 <= span:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if n < span:
        m = np.minimum(m[: len(m) - (span - n)], m[span - n :])
    count = len(m)
    mark = np.zeros(count + 1, np.int32)
    fits = ends - starts >= width
    np.add.at(mark, starts[fits], 1)
    np.add.at(mark, np.minimum(ends[fits] - width + 1, count), -1)
    valid = np.cumsum(mark[:count]) > 0
    change = np.empty(count, bool)
    change[0] = True
    change[1:] = (m[1:] != m[:-1]) | (valid[1:] != valid[:-1])
    change[starts[starts < count]] = True
    first = np.flatnonzero(change)
    length = np.diff(np.append(first, count))
    # a run may repeat itself only if its least string occurs in it twice; two next ones are ``span`` apart at most, where
    # one window begins with the first and the window after it ends with the second
    own = np.flatnonzero((h[:count] == m) & valid)
    twice = np.zeros(len(first), bool)
    for at in range(0, len(own), 1 << 15):
        q = own[at : at + (1 << 15)]
        near = h[np.minimum(q[:, None] + np.arange(1, span + 1), len(h) - 1)]
        tied = q[(near == h[q][:, None]).any(1)]
        twice[np.searchsorted(first, tied, "right") - 1] = True
    keep = valid[first]
    return m[first[keep]], first[keep], length[keep], twice[keep]


def _chunks(starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Lists of (row, offset in its text, first byte, last byte) of about ``_CHUNK`` bytes; long texts come in parts that share ``width - 1`` bytes."""
    out, size = [], 0
    for r, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if b - a < width:
            continue
        for at in range(a, b - width + 1, _LONG):
            stop = min(b, at + _LONG + width - 1)
            out.append((r, at - a, at, stop))
            size += stop - at
            if size >= _CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def _ids(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        *[F.col(f"`{c}`").cast("string").alias(f"carry_{k}") for k, c in enumerate(carry)],
    )


class _Runs:
    """Runs of windows that are found in texts, to be dealt by bucket."""

    def __init__(self, width: int, level: int = 0):
        self.width, self.level = width, level
        self.rolling = [RollingHash(_CHUNK + _LONG + 2 * width, odd, seed) for odd, seed in ((_ODD2, 5), (_ODD, 11))]
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, raw: np.ndarray, seg: np.ndarray, seg_end: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, above: np.ndarray | None = None) -> None:
        """Texts end to end, with each one's document, place in it and, within a hot bucket, that bucket."""
        h, first, length, twice = find_runs(raw, seg, seg_end, self.width, self.level)
        which = np.searchsorted(seg_end, first, "right")
        if above is not None:
            h = mix(above[which] * _ODD + h)
        text = [r.slices(r.sums(raw), first, first + length + self.width - 1) for r in self.rolling]
        self.found.append((h, *text, doc[which], row[which], (at[which] + first - seg[which]).astype(np.uint32), length.astype(np.uint32), twice))
        self.size += len(raw)

    def deal(self, n: int) -> Iterator[tuple[int, bytes]]:
        """(bucket part, block) of what was found since the last call."""
        if not self.found:
            return
        h, t1, t2, doc, row, at, length, twice = (np.concatenate(x) for x in zip(*self.found))
        self.found, self.size = [], 0
        order, bounds = split_by_part((mix(h) % np.uint64(n)).astype(np.int64), n)
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            o = order[bounds[p] : bounds[p + 1]]
            used, first, local = np.unique(row[o], return_index=True, return_inverse=True)
            yield p, pickle.dumps((h[o].tobytes() + t1[o].tobytes() + t2[o].tobytes(), squeeze(doc[o][first], used, local.astype(np.int32), at[o], length[o], twice[o])), 5)


def _run_blocks(ids: DataFrame, n: int, width: int) -> DataFrame:
    """Every document's runs as hashes, dealt into ``n`` parts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(width)

        def block() -> pa.RecordBatch:
            dealt = list(runs.deal(n))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in dealt], pa.int32()), pa.array([d for _, d in dealt], pa.binary())], names=["part", "data"])

        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, starts, ends = text_column(batch.column(2))
            for some in _chunks(starts, ends, width):
                raw = np.concatenate([buf[a:b] for _, _, a, b in some])
                r, at, a, b = (np.array([x[k] for x in some]) for k in range(4))
                stop = np.cumsum(b - a)
                runs.add(raw, stop - (b - a), stop, doc[r], row[r], at)
                if runs.size >= PART_BYTES:
                    yield block()
        if runs.size:
            yield block()

    return ids.select("doc", "row", "text").mapInArrow(lean(run), "part int, data binary")


def _deal(columns: Sequence[np.ndarray], doc: np.ndarray, row: np.ndarray, n: int, kind: int) -> list[tuple[int, int, bytes]]:
    """(document part, kind, block) of rows, dealt by their documents."""
    order, bounds = split_by_part(_doc_part(doc, row, n), n)
    return [(p, kind, squeeze(*[c[order[bounds[p] : bounds[p + 1]]] for c in (doc, row, *columns)])) for p in np.flatnonzero(np.diff(bounds)).tolist()]


def _doc_part(doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) * _ODD + row.view(np.uint64)) % np.uint64(n)).astype(np.int64)


REPEATED, PIECE, HOT = 0, 1, 2
_FOUND = "dpart int, kind int, data binary"


def _frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"dpart": np.array([r[0] for r in rows], np.int32), "kind": np.array([r[1] for r in rows], np.int32), "data": [r[2] for r in rows]})


def _collapse(n: int, hot: int):
    """Per bucket part: copies of pieces (repeated as a whole), and the pieces whose texts are to be compared."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for data in pdf["data"]:
            raw, rest = pickle.loads(data)
            hashes = np.frombuffer(raw, np.uint64).reshape(3, -1)
            doc, row, local, at, length, twice = expand(rest)
            blocks.append((*hashes, doc[local], row[local], at, length, twice))
        h, text, more, doc, row, at, length, twice = (np.concatenate(x) for x in zip(*blocks))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        many = np.zeros(len(h), bool)
        many[1:] |= same
        many[:-1] |= same
        keep = order[many | twice[order]]
        if not len(keep):
            return _frame([])
        keep = keep[np.lexsort((at[keep], row[keep], doc[keep], more[keep], text[keep], h[keep]))]
        h, text, more, doc, row, at, length, twice = (x[keep] for x in (h, text, more, doc, row, at, length, twice))
        new_bucket = np.append(True, h[1:] != h[:-1])
        first = new_bucket | np.append(True, (text[1:] != text[:-1]) | (more[1:] != more[:-1]))
        bucket = np.cumsum(new_bucket) - 1
        pieces = np.bincount(bucket, weights=first).astype(np.int64)[bucket]
        selfish = (np.bincount(bucket, weights=twice) > 0)[bucket]
        out = _deal((at[~first], length[~first]), doc[~first], row[~first], n, REPEATED)
        for kind, chosen in ((PIECE, first & ((pieces > 1) | selfish) & (pieces <= hot)), (HOT, first & (pieces > hot))):
            out += _deal((at[chosen], length[chosen], h[chosen]), doc[chosen], row[chosen], n, kind)
        return _frame(out)

    return run


def _text_frames(ids: DataFrame, n: int) -> DataFrame:
    """The documents' texts, compressed together, dealt into ``n`` parts by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, starts, ends = text_column(batch.column(2))
            extra = [batch.column(k).to_pylist() for k in range(3, batch.num_columns)]
            order, bounds = split_by_part(_doc_part(doc, row, n), n)
            press = zstandard.ZstdCompressor(level=3)
            part, data = [], []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[p] : bounds[p + 1]]
                joined = b"".join(buf[starts[i] : ends[i]].tobytes() for i in o)
                part.append(p)
                data.append(pickle.dumps((doc[o], row[o], ends[o] - starts[o], press.compress(joined), [[e[i] for i in o] for e in extra]), 5))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["dpart", "data"])

    return ids.mapInArrow(lean(run), "dpart int, data binary")


def _requests(found: pd.DataFrame, kinds: Sequence[int]) -> dict[tuple[int, int], list[tuple]]:
    """Requests or intervals by document."""
    out: dict[tuple[int, int], list[tuple]] = {}
    for kind, data in zip(found["kind"], found["data"]):
        if kind not in kinds:
            continue
        doc, row, *rest = expand(data)
        order = np.lexsort((row, doc))
        cuts = np.flatnonzero(np.append(True, (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1]))) if len(order) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            o = order[a:b]
            out.setdefault((int(doc[o[0]]), int(row[o[0]])), []).append((kind, *[x[o] for x in rest]))
    return out


def _fetch(n: int, width: int, level: int):
    """Per document part: the texts of requested pieces, dealt by bucket; runs of hot buckets' pieces in the order of ``level``."""

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        wanted = _requests(found, (PIECE, HOT))
        out: list[tuple[int, int, bytes]] = []
        runs = _Runs(width, level)
        press = zstandard.ZstdCompressor(level=3)

        def deal(piece: list[tuple], body: list[bytes]) -> None:
            h, doc, row, at, length = (np.concatenate(x) for x in zip(*piece))
            order, bounds = split_by_part((mix(h) % np.uint64(n)).astype(np.int64), n)
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[p] : bounds[p + 1]]
                out.append((p, PIECE, pickle.dumps((h[o], squeeze(doc[o], row[o], at[o], length[o]), press.compress(b"".join(body[i] for i in o))), 5)))

        piece, body, hot, waiting = [], [], [], 0

        def flush() -> None:
            part, *plain = zip(*hot)
            doc, row, at, above = (np.array(x, t) for x, t in zip(plain, (np.int64, np.int64, np.int64, np.uint64)))
            size = np.array(list(map(len, part)))
            runs.add(np.concatenate(part), np.cumsum(size) - size, np.cumsum(size), doc, row, at, above)
            hot.clear()

        for data in texts["data"]:
            doc, row, size, packed, _ = pickle.loads(data)
            hit = [i for i in range(len(doc)) if (int(doc[i]), int(row[i])) in wanted]
            if not hit:
                continue
            raw, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(size)
            for i in hit:
                base = int(ends[i] - size[i])
                for kind, at, length, h in wanted.pop((int(doc[i]), int(row[i]))):
                    if kind == PIECE:
                        piece.append((h, np.full(len(h), doc[i]), np.full(len(h), row[i]), at, length))
                        body += [raw[base + a : base + a + k + width - 1] for a, k in zip(at.tolist(), length.tolist())]
                        continue
                    for a, k, above in zip(at.tolist(), length.tolist(), h):
                        for b in range(a, a + k, _LONG):
                            hot.append((np.frombuffer(raw, np.uint8, min(_LONG, a + k - b) + width - 1, base + b), doc[i], row[i], b, above))
                            waiting += len(hot[-1][0])
                            if waiting >= _CHUNK:
                                flush()
                                waiting = 0
        if hot:
            flush()
        if piece:
            deal(piece, body)
        out += [(p, HOT, d) for p, d in runs.deal(n)]
        return _frame(out)

    return run


def shard_bwt(text: np.ndarray, base: np.ndarray, place: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard's strings and its transform: the ``STEP`` bytes before each suffix, as codes.

    Strings are circular and end in a mark that sorts before all bytes; ``base``, ``place`` and ``size`` give each
    position's string start, place in it and string length.
    """
    rank, depth, total = code.astype(np.int64), STEP, len(text)
    while True:
        key = rank * np.int64(1 << 31) + rank[base + (place + depth) % size]
        order = np.argsort(key)
        step = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(total, np.int64)
        rank[order] = step
        depth *= 2
        if step[-1] == total - 1:
            return order, code[(base + (place - STEP) % size)[order]]
        if depth > 2 * size.max():
            raise ValueError("two strings of a shard are equal")


def merge_bwts(left: np.ndarray, right: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms sorted by ``rounds`` symbols, and each suffix's block of equal prefixes.

    The result's bit says whether the next suffix is the right one's; within a transform the order stays.
    """
    total = len(left) + len(right)
    side = np.zeros(total, bool)
    side[len(left) :] = True
    block = np.zeros(total, np.int32)
    symbol = np.empty(total, left.dtype)
    for _ in range(rounds):
        symbol[~side] = left
        symbol[side] = right
        order = np.argsort(symbol, kind="stable")
        side, block, dealt = side[order], block[order], symbol[order]
        block = np.append(np.int32(0), np.cumsum((dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1]), dtype=np.int32))
        if block[-1] == total - 1:  # every suffix stands alone
            break
    return side, block


def repeated_windows(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different strings (in document order): the windows that occur more than once, as string, place and class."""
    step = STEP if width % STEP == 0 else 1
    if step != STEP:
        raise ValueError(f"width must be a multiple of {STEP}")
    size = np.array([-(-(len(s) + 1) // STEP) * STEP for s in strings], np.int64)
    start = np.cumsum(size) - size
    total = int(size.sum())
    text = np.zeros(total, np.uint8)
    for s, a in zip(strings, start.tolist()):
        text[a : a + len(s)] = np.frombuffer(s, np.uint8)
        text[a : a + len(s)] += 1  # no UTF-8 byte is 255
    which = np.repeat(np.arange(len(strings)), size)
    base, length = start[which], size[which]
    place = np.arange(total) - base
    gram = np.zeros(total, np.uint64)
    for k in range(STEP):
        gram = gram * np.uint64(256) + text[base + (place + k) % length]
    alphabet, code = np.unique(gram, return_inverse=True)
    code = code.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    # shards of whole strings, in document order
    shard = start // SHARD
    cuts = [*start[np.flatnonzero(np.diff(shard, prepend=-1))].tolist(), total]
    if len(cuts) == 2 and len(strings) > 1:
        cuts.insert(1, int(start[len(strings) // 2]))
    level = []
    for a, b in zip(cuts, cuts[1:]):
        order, bwt = shard_bwt(text[a:b], base[a:b] - a, place[a:b], length[a:b], code[a:b])
        level.append((order + a, bwt))
    if len(level) == 1:  # one string: its blocks are found by the same rounds
        level.append((np.zeros(0, np.int64), code[:0]))
    while len(level) > 1:
        above = []
        for (x, left), (y, right) in zip(level[::2], level[1::2]):
            side, block = merge_bwts(left, right, width // STEP)
            at, bwt = np.empty(len(side), np.int64), np.empty(len(side), code.dtype)
            at[~side], at[side] = x, y
            bwt[~side], bwt[side] = left, right
            above.append((at, bwt))
        level = above + level[len(level) & ~1 :]
    at = level[0][0]
    count = np.bincount(block)
    windows = np.array([len(s) for s in strings])[which[at]] - place[at] >= width
    chosen = (count[block] > 1) & windows
    return which[at[chosen]], place[at[chosen]], block[chosen]


def _intervals(string: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places: string, first place, places."""
    order = np.lexsort((place, string))
    s, p = string[order], place[order]
    cut = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1))) if len(s) else np.zeros(0, np.int64)
    return s[cut], p[cut], np.diff(np.append(cut, len(s)))


def _compare(n: int, width: int):
    """Per bucket part: which windows of the pieces start earlier elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, bytes]] = []
        blocks, body = [], []
        for data in pdf["data"]:
            h, rest, packed = pickle.loads(data)
            blocks.append((h, *expand(rest)))
            raw = zstandard.ZstdDecompressor().decompress(packed)
            stop = np.cumsum(blocks[-1][4].astype(np.int64) + width - 1)
            body += [raw[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]
        if blocks:
            h, doc, row, at, length = (np.concatenate(x) for x in zip(*blocks))
            order = np.lexsort((at, row, doc, h))
            edges = np.append(np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])), len(order))
            units, unit, size = [], [], 0
            for a, b in zip(edges, edges[1:]):
                own = int(length[order[a:b]].sum()) + (b - a) * (width + STEP)
                if unit and size + own > UNIT:
                    units.append(unit)
                    unit, size = [], 0
                unit.extend(order[a:b].tolist())
                size += own
            if unit:
                units.append(unit)
            results = []
            for unit in units:
                ids = np.array(unit)
                ids = ids[np.lexsort((at[ids], row[ids], doc[ids]))]
                string, place, block = repeated_windows([body[i] for i in ids], width)
                if not len(string):
                    continue
                # the string's number orders documents, so the first start is the least (document, place)
                owner = np.cumsum(np.append(0, (doc[ids][1:] != doc[ids][:-1]) | (row[ids][1:] != row[ids][:-1])))
                key = (owner[string] << 34) + at[ids][string].astype(np.int64) + place
                by = np.lexsort((key, block))
                later = by[np.append(False, block[by][1:] == block[by][:-1])]
                s, p, k = _intervals(string[later], place[later])
                results.append((doc[ids][s], row[ids][s], (at[ids][s] + p).astype(np.uint32), k.astype(np.uint32)))
            if results:
                doc, row, at, k = (np.concatenate(x) for x in zip(*results))
                out += _deal((at, k), doc, row, n, REPEATED)
        return _frame(out)

    return run


def _finish(width: int, keep_text: bool, carry: int):
    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        marks = _requests(found, (REPEATED,))
        rows = []
        for data in texts["data"]:
            doc, row, size, packed, extra = pickle.loads(data)
            raw = zstandard.ZstdDecompressor().decompress(packed)
            stop = 0
            for i in range(len(doc)):
                begin, stop = stop, stop + int(size[i])
                text = raw[begin:stop]
                got = marks.get((int(doc[i]), int(row[i])))
                removed = spans = 0
                if got:
                    a = np.concatenate([x[1] for x in got]).astype(np.int64)
                    b = a + np.concatenate([x[2] for x in got]).astype(np.int64) + width - 1
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > reach[:-1])
                    left, right = a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
                    removed, spans = int((right - left).sum()), len(left)
                    text = b"".join(text[x:y] for x, y in zip([0, *right.tolist()], [*left.tolist(), len(text)]))
                rows.append((None if doc[i] == _NULL_ID else int(doc[i]), int(size[i]), removed, spans, hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "ignore")] if keep_text else []), *[e[i] for e in extra]))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if keep_text else []), *[f"carry_{k}" for k in range(carry)]]
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: Sequence[str] = (), hot: int = HOT_PIECES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept.

    With ``keep_text`` also that text, without bytes that a cut left of a character; ``carry`` columns come along.
    """
    if width % STEP or width < 2 * GRAM:
        raise ValueError(f"width must be a multiple of {STEP} and at least {2 * GRAM}")
    scratch = Scratch(docs.sparkSession, "suffixes")
    # numbered and stored once: numbers made anew in each job follow its splits, which change with the executors
    rows = scratch.save(_ids(pick(docs, *dict.fromkeys([id_col, text_col, *carry])), id_col, text_col, carry), "rows")
    n = text_parts(rows, "text", PART_BYTES)
    ids = rows.select("doc", "row", "text")
    by_doc = lambda df: df.groupBy("dpart")
    runs, repeated, pieces = _run_blocks(ids, n, width), [], []
    for level in range(1, LEVELS + 1):
        found = scratch.save(runs.groupBy("part").applyInPandas(lean(_collapse(n, hot if level < LEVELS else 1 << 62)), _FOUND), f"found{level}")
        fetched = by_doc(_text_frames(ids, n)).cogroup(by_doc(found.where(F.col("kind") != REPEATED))).applyInPandas(lean(_fetch(n, width, level)), _FOUND)
        fetched = scratch.save(fetched, f"fetched{level}")
        repeated.append(found.where(F.col("kind") == REPEATED))
        pieces.append(fetched.where(F.col("kind") == PIECE))
        runs = fetched.where(F.col("kind") == HOT).select(F.col("dpart").alias("part"), "data")
        if runs.isEmpty():
            break
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    compared = scratch.save(by_doc(union(pieces)).applyInPandas(lean(_compare(n, width)), _FOUND), "compared")
    repeated = union([*repeated, compared])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", text string" * keep_text + "".join(f", carry_{k} string" for k in range(len(carry)))
    out = by_doc(_text_frames(rows, n)).cogroup(by_doc(repeated)).applyInPandas(lean(_finish(width, keep_text, len(carry))), schema)
    return out.withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)})
