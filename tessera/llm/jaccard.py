"""Exact set-similarity join of documents over word n-grams, by a grouped prefix join.

A document's set holds its distinct ``words``-word shingles; two documents link when the Jaccard similarity of their
sets is at least ``percent`` hundredths. In any fixed order of the shingles, two such sets share one in their first
``n - ceil(percent * n / 100) + 1``. The order puts frequent shingles last: those that over ``RARE`` documents hold,
at most ``MOST_FREQUENT`` of them (which ones are in that table changes the cost, never the result).

Documents with one prefix and size are one group, and documents with one set are one member of it, so copies cost
nothing. Shingles are compared by hashes of 64 bits. Groups that share a prefix shingle form lists; identical lists are one. Pairs within a list or group pass a
filter on sizes and one on parity bitmaps (the symmetric difference of two sets is at least the number of bits in
which their bitmaps differ) before whole sets are compared. First each list is only chained by size and starred
around its most common document, and each group starred: that links what is alike with few pairs. Then the pairs of
lists and groups whose ends are in different components are filtered, all of them, in blocks of ``BLOCK`` rows a side;
pairs within a component cannot change it.

Defined cases: fewer words than a shingle has make the whole sequence the only element; a null or empty text, or one
of white space, has an empty set, size 0, and links with nothing; a null doc_id takes part, and a component's id is
its least doc_id that is not null; repeated rows are rows of their own; an empty table gives an empty table. Other
columns are ignored. Rows are numbered when they are first read, and stored with their numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ODD, ODD2, RollingHash, Scratch, expand, lean, mix, per_row, pick, slices, split_by_part, squeeze, text_column, text_parts, with_row
from tessera.llm.components import components

RARE = 8
BLOCK = 2048
#: Bytes of text that a task deals with.
PART_BYTES = 6 << 20
_SMALL = 48
MOST_FREQUENT = 1 << 20
_CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.rolling = words, RollingHash(2 * _CHUNK, ODD2, 17)

    def sets(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        a, n = 0, len(starts)
        while a < n:
            b, size = a, 0
            while b < n and (b == a or size + ends[b] - starts[b] < _CHUNK):
                size += int(ends[b] - starts[b]) + 1
                b += 1
            yield from self._chunk(buf, starts[a:b], ends[a:b], size)
            a = b

    def _chunk(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
        raw = np.full(size, 32, np.uint8)
        edge = np.cumsum(ends - starts + 1)
        for a, b, e in zip(starts.tolist(), ends.tolist(), edge.tolist()):
            raw[e - 1 - (b - a) : e - 1] = buf[a:b]
        raw = _LOWER[raw]
        white = _WHITE[raw]
        inside = np.append(False, ~white).astype(np.int8)
        turn = np.diff(inside)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        if size > self.rolling.length:
            self.rolling = RollingHash(size, ODD2, 17)
        word = self.rolling.slices(self.rolling.sums(raw), first, last) if len(first) else np.zeros(0, np.uint64)
        k = self.words
        bounds = np.searchsorted(first, np.append(0, edge))
        if len(word) >= k:
            h = word[: len(word) - k + 1].copy()
            for j in range(1, k):
                h = h * ODD + word[j : len(word) - k + 1 + j]
            h = mix(h)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a >= k:
                s = np.sort(h[a : b - k + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for w in word[a:b]:
                    whole = mix(whole * ODD + w)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _slot(tokens: np.ndarray) -> np.ndarray:
    """The 32-bit cell in which a shingle is counted."""
    return (mix(tokens * ODD2) >> np.uint64(32)).astype(np.uint32)


def _token_counts(words: int, n: int):
    """How many sets hold each shingle, dealt by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 0):
            cells = [_slot(s) for s in shingler.sets(*text_column(batch.column(0))) if len(s)]
            if not cells:
                continue
            cell, count = np.unique(np.concatenate(cells), return_counts=True)
            order, bounds = split_by_part((cell % np.uint32(n)).astype(np.int64), n)
            part, data = [], []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[p] : bounds[p + 1]]
                part.append(p)
                step = np.diff(cell[o].astype(np.int64), prepend=0).astype(np.uint32)
                data.append(squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T), np.minimum(count[o], 65535).astype(np.uint16)))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    return run


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    cells, counts = [], []
    for data in pdf["data"]:
        step, count = expand(data)
        cells.append(np.cumsum(np.ascontiguousarray(step.T).view(np.uint32).ravel().astype(np.int64)))
        counts.append(count)
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    often = total > RARE
    return pd.DataFrame({"cell": cell[often], "count": total[often]})


def frequent_cells(rows: DataFrame, scratch: Scratch, words: int, n: int) -> np.ndarray:
    """Cells of the most frequent shingles: over ``RARE`` documents, and at most ``MOST_FREQUENT`` (4 MB) of them."""
    counted = rows.select("text").mapInArrow(lean(_token_counts(words, n)), "part int, data binary")
    table = scratch.save(counted.groupBy("part").applyInPandas(lean(_sum_counts), "cell long, count long"), "frequent")
    classes = table.groupBy(F.floor(F.log2("count")).alias("c")).count().collect()  # at most 64 rows
    least, total = 64, 0
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["c"]
    got = table.where(F.floor(F.log2("count")) >= least).select("cell").toPandas()["cell"]
    return np.sort(got.to_numpy(np.uint32))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bits of a set: each element flips one of about as many bits as there are elements."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes | np.ndarray, b: bytes | np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their bitmaps; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _most_apart(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of sets of these sizes that are as similar as asked; negative if their sizes differ too much."""
    total = x + y
    most = total + 2 * (-percent * total // (100 + percent))
    return np.where(np.minimum(x, y) * 100 >= percent * np.maximum(x, y), most, -1)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _matrix_pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray, part: np.ndarray, bits: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of ``left`` and ``right`` rows in different components, those whose sizes and bitmaps allow the similarity."""
    found_a, found_b = [], []
    width = np.array([len(b) for b in bits])
    for wa in np.unique(width[left]):
        a = left[width[left] == wa]
        for wb in np.unique(width[right]):
            b = right[width[right] == wb]
            if max(wa, wb) > 2 * min(wa, wb):
                continue  # sizes differ too much
            w = min(wa, wb)
            x, y = (_fold(np.stack([bits[i] for i in s]), w) for s in (a, b))
            step = max(1, (1 << 21) // (len(b) * w))
            for at in range(0, len(a), step):
                s = a[at : at + step]
                most = _most_apart(n[s][:, None], n[b][None, :], percent)
                apart = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                i, j = np.nonzero((apart <= most) & (part[s][:, None] != part[b][None, :]))
                found_a.append(s[i])
                found_b.append(b[j])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


def _cross(percent: int):
    """Per task: the pairs of its lists' blocks that lie in different components and pass the filters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list_id", "i", "j"], kind="stable").reset_index(drop=True)
        node, n, part = (pdf[c].to_numpy() for c in ("node", "n", "part"))
        own, i, j, list_id = (pdf[c].to_numpy() for c in ("own", "i", "j", "list_id"))
        bits = [np.frombuffer(b, np.uint64) for b in pdf["bits"]]
        cut = np.flatnonzero(np.append(True, (list_id[1:] != list_id[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        stop = np.append(cut[1:], len(pdf))
        a, b = [], []
        size = stop - cut
        for m in np.unique(size[size <= _SMALL]).tolist():  # lists of one size together
            first, second = np.triu_indices(m, 1)
            base = cut[size == m][:, None]
            x, y = (base + first).ravel(), (base + second).ravel()
            # rows of one block meet in the task of that block alone
            ok = (part[x] != part[y]) & ((own[x] != own[y]) | (i[x] == j[x])) & (_most_apart(n[x], n[y], percent) >= 0)
            x, y = x[ok], y[ok]
            low, high = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            _, once = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
            x, y = x[once], y[once]
            most = _most_apart(n[x], n[y], percent)
            keep = [differing_bits(bits[p], bits[q]) <= k for p, q, k in zip(x.tolist(), y.tolist(), most.tolist())]
            a.append(x[keep])
            b.append(y[keep])
        for s, e in zip(cut[size > _SMALL].tolist(), stop[size > _SMALL].tolist()):
            rows = np.arange(s, e)
            left, right = (rows, rows) if i[s] == j[s] else (rows[own[rows] == i[s]], rows[own[rows] == j[s]])
            common, count = np.unique(part[rows], return_counts=True)
            major = common[count.argmax()]  # its members need not meet each other
            for x, y in ((left[part[left] != major], right), (left[part[left] == major], right[part[right] != major])):
                if len(x) and len(y):
                    p, q = _matrix_pairs(x, y, n, part, bits, percent)
                    a.append(p)
                    b.append(q)
        x, y = (node[np.concatenate(v)] if v else np.zeros(0, np.int64) for v in (a, b))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


_SIGNED = "part int, doc long, row long, n long, common long, gid long, f1 long, f2 long, bits binary, data binary"


def _sign(words: int, percent: int, n: int, frequent: np.ndarray):
    """Per document: size, group, fingerprint and bitmap; per part of the shingles: the groups' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 2):
            m = batch.num_rows
            size, common, gid, f1, f2 = np.zeros(m, np.int64), np.zeros(m, np.int64), *(np.zeros(m, np.uint64) for _ in range(3))
            bits: list[bytes] = []
            seen: dict[int, int] = {}
            prefix, owner, group_size = [], [], []
            for i, s in enumerate(shingler.sets(*text_column(batch.column(2)))):
                size[i] = len(s)
                if not len(s):
                    bits.append(b"")
                    continue
                cell = _slot(s)
                at = np.minimum(np.searchsorted(frequent, cell), max(len(frequent) - 1, 0))
                often = frequent[at] == cell if len(frequent) else np.zeros(len(s), bool)
                common[i] = often.sum()
                front = np.concatenate([s[~often], s[often]])[: prefix_size(len(s), percent)]
                f1[i], f2[i] = mix(s * ODD).sum(), mix(s + ODD2).sum()
                gid[i] = mix(mix(front).sum(keepdims=True) + np.array([len(s)], np.uint64) * ODD2)[0]
                bits.append(bitmap(s))
                key = int(gid[i])
                if key not in seen:
                    seen[key] = len(group_size)
                    group_size.append(len(s))
                    prefix.append(front)
                    owner.append(np.full(len(front), seen[key], np.int32))
            none = pa.nulls(m, pa.binary())
            signed = lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1, np.int32)), batch.column(0), batch.column(1), pa.array(size), pa.array(common), signed(gid), signed(f1), signed(f2), pa.array(bits, pa.binary()), none], names=[x.split()[0] for x in _SIGNED.split(", ")])
            if not prefix:
                continue
            token, own = np.concatenate(prefix), np.concatenate(owner)
            ids, sizes = np.fromiter(seen, np.uint64, len(seen)), np.array(group_size, np.int64)
            order, bounds = split_by_part((mix(token) % np.uint64(n)).astype(np.int64), n)
            part, data = [], []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[p] : bounds[p + 1]]
                used, local = np.unique(own[o], return_inverse=True)
                part.append(p)
                data.append(pickle.dumps((token[o].tobytes(), ids[used].tobytes(), squeeze(sizes[used], local.astype(np.int32))), 5))
            k = len(part)
            empty = lambda t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[empty(pa.int64()) for _ in range(7)], empty(pa.binary()), pa.array(data, pa.binary())], names=[x.split()[0] for x in _SIGNED.split(", ")])

    return run


def _lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups that share a prefix shingle, identical lists once: list_id, gid, n."""
    tokens, gids, sizes = [], [], []
    for data in pdf["data"]:
        token, gid, rest = pickle.loads(data)
        size, local = expand(rest)
        tokens.append(np.frombuffer(token, np.uint64))
        gids.append(np.frombuffer(gid, np.uint64)[local])
        sizes.append(size[local])
    token, gid, size = np.concatenate(tokens), np.concatenate(gids), np.concatenate(sizes)
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    many = np.append(False, same) | np.append(same, False)
    keep = order[many]
    keep = keep[np.lexsort((gid[keep], token[keep]))]
    token, gid, size = token[keep], gid[keep], size[keep]
    once = np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])) if len(token) else np.zeros(0, bool)
    token, gid, size = token[once], gid[once], size[once]
    if not len(token):
        return pd.DataFrame({"list_id": np.zeros(0, np.int64), "gid": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    count = np.diff(np.append(cut, len(token)))
    name = mix(np.add.reduceat(mix(gid * ODD), cut) + count.astype(np.uint64))
    _, first = np.unique(name, return_index=True)
    chosen = np.zeros(len(cut), bool)
    chosen[first] = True
    chosen &= count > 1
    rows = np.repeat(chosen, count)
    return pd.DataFrame({"list_id": np.repeat(name, count)[rows].view(np.int64), "gid": gid[rows].view(np.int64), "n": size[rows]})


def _alike(percent: int, a: str, b: str):
    """The sizes allow the similarity."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _bit_filter(percent: int):
    """Pairs whose bitmaps allow the similarity: 100 * i >= percent * u leaves at most this much difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            total = na + nb
            least = -(-percent * total // (100 + percent))
            most = total - 2 * least
            keep = [differing_bits(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist())]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch, words: int, percent: int, n: int, label: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar as asked."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").where(_alike(percent, "n_a", "n_b"))
    left = scratch.save(sized.mapInArrow(lean(_bit_filter(percent)), "a long, b long"), f"{label}-pairs")
    left = left.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(n)).cast("int"))
    # a set goes once to each part that has a pair with it
    asked = left.select(F.col("a").alias("row"), F.col("part").alias("pair_part")).unionByName(left.select(F.col("b").alias("row"), F.col("part").alias("pair_part"))).distinct()

    def fetch(texts: Iterator[tuple], own: pd.DataFrame) -> pd.DataFrame:
        shingler, out = Shingler(words), {"part": [], "data": []}
        wanted = {int(r): g["pair_part"].tolist() for r, g in own.groupby("row")}
        for row, text, _ in texts:
            if row in wanted:
                raw = np.frombuffer(text or b"", np.uint8)
                (s,) = shingler.sets(raw, np.array([0]), np.array([len(raw)]))
                body = s.tobytes()
                for p in wanted[row]:
                    out["part"].append(p)
                    out["data"].append(pickle.dumps((row, body), 5))
        return pd.DataFrame({"part": np.array(out["part"], np.int32), "data": out["data"]})

    def compare(sent: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held = {row: np.frombuffer(body, np.uint64) for row, body in map(pickle.loads, sent["data"])}
        linked = []
        for a, b in own[["a", "b"]].itertuples(index=False):
            x, y = held[a], held[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                linked.append((a, b))
        return pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

    sets = per_row(rows, asked, fetch, "part int, data binary", n)
    return scratch.save(sets.groupBy("part").cogroup(left.groupBy("part")).applyInPandas(lean(compare), "a long, b long"), f"{label}-links")


def _stored(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """doc, row, text and carried columns, numbered and stored once, as numbers made anew follow the splits of their job."""
    return scratch.save(with_row(pick(docs, *dict.fromkeys([id_col, text_col, *carry])), id_col, text_col, carry), "rows")


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row, n_shingles, component_id (least doc_id of its component) and kept (one row of each)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    return _link(_stored(docs, id_col, text_col, (), scratch), scratch, words, percent)


def _link(rows: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    n = text_parts(rows, "text", PART_BYTES)
    frequent = frequent_cells(rows, scratch, words, n)
    signed = scratch.save(rows.mapInArrow(lean(_sign(words, percent, n, frequent)), _SIGNED), "signed")
    members = signed.where("part < 0").select("doc", "row", "n", "common", "gid", "f1", "f2", "bits")
    key = ["n", "f1", "f2"]
    nodes = members.where("n > 0").groupBy(*key).agg(F.min("row").alias("node"), F.min("gid").alias("gid"), F.min("common").alias("common"), F.min("bits").alias("bits"), F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "row")).alias("best"))
    nodes = scratch.save(nodes, "nodes")
    entries = signed.where("part >= 0").select("part", "data").groupBy("part").applyInPandas(lean(_lists), "list_id long, gid long, n long")
    entries = scratch.save(entries.distinct(), "entries")
    leaders = nodes.groupBy("gid").agg(F.min("node").alias("leader"), F.max("common").alias("common"), F.count(F.lit(1)).alias("size"))
    led = entries.join(leaders, "gid")
    by_size = Window.partitionBy("list_id").orderBy("n", "gid")
    by_rank = Window.partitionBy("list_id").orderBy((F.col("common") / F.col("n")).desc(), "gid")
    led = led.select(F.col("leader").alias("x"), "n", *[f(c).over(w).alias(v) for f, w, c, v in ((F.lag, by_size, "leader", "before"), (F.lag, by_size, "n", "before_n"), (F.first, by_rank, "leader", "centre"), (F.first, by_rank, "n", "centre_n"))])
    pairs = led.where("before is not null").where(_alike(percent, "n", "before_n")).select("x", F.col("before").alias("y"))
    pairs = pairs.unionByName(led.where(_alike(percent, "n", "centre_n")).select("x", F.col("centre").alias("y")))
    star = nodes.join(leaders.where("size > 1"), "gid").where("node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y"))
    ordered = lambda p: p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
    links = _verify(ordered(pairs.unionByName(star)), nodes, rows, scratch, words, percent, n, "chained")
    linked = components(links, scratch, "first")

    at = nodes.join(linked.select(F.col("a").alias("node"), F.col("b").alias("up")), "node", "left").select("node", "gid", "n", F.coalesce("up", "node").alias("part"))
    at = scratch.save(at, "placed")
    spread = at.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    seen = entries.join(spread, "gid")
    mixed = seen.groupBy("list_id").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("list_id")
    split = spread.where("low <> high").select("gid")
    placed = at.join(nodes.select("node", "bits"), "node").select("gid", "node", "n", "part", "bits")
    across = seen.join(mixed, "list_id", "left_semi").select("list_id", "gid").join(placed, "gid").drop("gid")
    within = placed.join(split, "gid", "left_semi").withColumn("list_id", F.xxhash64("gid", F.lit(7))).drop("gid")
    open_lists = scratch.save(across.unionByName(within), "open")
    pieces = open_lists.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    dealt = open_lists.join(pieces, "list_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "pieces")
    met = dealt.withColumn("task", F.pmod(F.xxhash64("list_id", "i", "j"), F.lit(8 * n)).cast("int"))
    crossed = met.groupBy("task").applyInPandas(lean(_cross(percent)), "a long, b long").distinct()
    more = _verify(crossed, nodes, rows, scratch, words, percent, n, "crossed")
    final = linked if more.isEmpty() else components(linked.unionByName(more), scratch, "last")

    rooted = nodes.join(final.select(F.col("a").alias("node"), F.col("b").alias("up")), "node", "left").withColumn("root", F.coalesce("up", "node"))
    bests = rooted.groupBy("root").agg(F.min("best").alias("chosen"))
    owners = rooted.join(bests, "root").select(*key, F.col("chosen.doc").alias("component_id"), F.col("chosen.row").alias("chosen_row"))
    out = members.select("doc", "row", *key).join(owners, key, "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("doc").alias("doc_id"), "row", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("chosen_row"))).alias("kept"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and carried columns (as strings) of one row of each component of :func:`link_documents`."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = _stored(docs, id_col, text_col, carry, scratch)
    linked = _link(rows.select("doc", "row", "text"), scratch, words, percent)
    n = text_parts(rows, "text", PART_BYTES)
    names = ["doc_id", "text", *[f"carry_{k}" for k in range(len(carry))]]

    def run(texts: Iterator[tuple], own: pd.DataFrame) -> pd.DataFrame:
        kept = set(own["row"])
        got = [(plain[0], None if text is None else text.decode("utf-8", "replace"), *plain[1:]) for row, text, plain in texts if row in kept]
        out = pd.DataFrame(got, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = "doc_id long, text string" + "".join(f", carry_{k} string" for k in range(len(carry)))
    kept = per_row(rows, linked.where("kept").select("row"), run, schema, n)
    return kept.withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)})
