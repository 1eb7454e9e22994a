"""How the sources of a language differ in their terms: an exact audit by upper bounds.

A term's probability in a group of documents (those of one language and source), and in the whole language, is a whole
number of billionths: ``1 + floor(1e9 (count + 1) / (N + V))``, where ``V`` terms are kept (they stand in enough
documents of the language) and ``N`` is the sum of their counts. Divergence of ``p`` from ``q`` is
``floor((p - q)^2 / q)``.

*Terms of a group against its language.* A group's terms are put into buckets of near counts. A bucket keeps its
greatest ``p`` and the least ``q`` among its terms, which bound what any of them can diverge. Buckets are evaluated best
bound first, in growing steps; each step raises the group's k-th best value, and the search ends when the bounds of all
unseen buckets lie strictly below it. Only terms of evaluated buckets are scored.

*Source against source.* For two groups most kept terms have a zero count on one or both sides. With ``z`` as the
probability of a zero count, the sum over all kept terms is

    V f(zg, zs) + sum over g's terms of (f(pg, zs) - f(zg, zs)) + sum over s's terms of (f(zg, ps) - f(zg, zs))
      + sum over shared terms of (f(pg, ps) - f(pg, zs) - f(zg, ps) + f(zg, zs))

The two middle sums need a group's histogram of counts only. The last one comes from postings: a term's list of sources
gives the pairs it is shared by. A list is no longer than a language has sources, whose square is the size of the result.

Counts are summed within a batch of texts before they are shuffled, and again before each shuffle, so a frequent term
or a large source is no hot key. Nothing is collected.

Defined cases: null text, lang and source are empty strings; a group without terms still takes part; a language without
kept terms has pairs of value 0 and no terms; repeated rows count as documents each; terms run to any length; an empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, pick, slices, text_column

#: Bytes of text that are counted at a time.
SLICE = 16 << 20
#: Buckets of counts for each doubling.
FINE = 8
#: How many times more terms each step of the search may take in than the one before.
GROWTH = 8
#: Billionths as a product, so that the quotient stays within 64 bits for counts up to 2.8e14.
_SCALE = (32_000, 31_250)

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def terms(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of texts that lie one after another in ``raw``, and each one's text: runs of letters and bytes above 127."""
    low = _LETTERS[raw]
    inside = low != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    begins = inside & (edge[:-1] | ~np.append(False, inside[:-1]))
    first = np.flatnonzero(begins)
    kept = np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(kept, first), len(kept)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low[kept])])
    return found, np.searchsorted(starts, first, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and the texts that hold it, by group, of some texts."""
    for batch in slices(batches, 2, SLICE):
        buf, starts, ends = text_column(batch.column(2))
        if not batch.num_rows or ends[-1] == starts[0]:
            continue
        full = np.flatnonzero(ends > starts)
        found, text = terms(buf[starts[0] : ends[-1]], starts[full] - starts[0])
        if not len(found):
            continue
        numbers: dict[tuple[str, str], int] = {}
        group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(*(batch.column(k).to_pylist() for k in (0, 1)))], np.int64)[full]
        coded = found.dictionary_encode()
        size = len(coded.dictionary)
        each, n = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key, place = np.unique(group[each // size] * size + each % size, return_inverse=True)
        names = list(numbers)
        word = coded.dictionary.take(pa.array(key % size)).cast(pa.large_string())
        columns = [pa.array([names[g][k] for g in key // size], pa.string()) for k in (0, 1)]
        columns += [word.cast(pa.string()), pa.array(np.bincount(place, n).astype(np.int64)), pa.array(np.bincount(place).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def probability(count: str, whole: str) -> Column:
    """``1 + floor(1e9 (count + 1) / whole)`` of two columns, ``count < whole``, as a division in two steps."""
    a, b = _SCALE
    high = f"({count} + 1) * {a}L"
    return F.expr(f"1 + ({high} div {whole}) * {b}L + (({high} % {whole}) * {b}L) div {whole}")


def divergence(p: str, q: str) -> Column:
    """``floor((p - q)^2 / q)`` of two columns."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _entries(docs: DataFrame, scratch: Scratch, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, size, lang_size, kept, zero) and the counts of their kept terms (lang, source, term, n, p, q, zero)."""
    counted = docs.mapInArrow(lean(_count), "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    postings = scratch.save(postings.where(F.col("docs") >= least_docs).drop("docs"), "postings")
    langs = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_size"))
    one = postings.select("lang", "term", "total", F.inline("held"))
    sizes = one.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["size", "kept", "lang_size"]).withColumn("whole", F.greatest(F.col("size") + F.col("kept"), F.lit(1)))
    groups = scratch.save(groups.withColumn("none", F.lit(0)).withColumn("zero", probability("none", "whole")).drop("none"), "groups")
    known = groups.select("lang", "source", "whole", "zero", (F.col("lang_size") + F.col("kept")).alias("lang_whole"))
    entries = one.join(known, ["lang", "source"])
    entries = entries.select("lang", "source", "term", "n", probability("n", "whole").alias("p"), probability("total", "lang_whole").alias("q"), "zero")
    return groups, scratch.save(entries, "entries")


def _best_terms(entries: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The ``k`` terms of each group that diverge most from their language, among those with p > q: lang, source, item, value, rank."""
    bucket = F.floor(F.log2("n") * FINE).cast("int").alias("bucket")
    group = ["lang", "source"]
    rated = entries.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("terms"), F.max("p").alias("p"), F.min("q").alias("q"))
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    before = F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1))
    rated = rated.where("p > q").select(*group, "bucket", "terms", divergence("p", "q").alias("bound"))
    rated = scratch.save(rated.select(*group, "bucket", "bound", F.coalesce(before, F.lit(0)).alias("before")), "buckets")

    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    step, low, high, found = 0, 0, k, None
    while True:
        unseen = rated.where(F.col("before") >= low)
        if found is not None:
            kth = found.where(F.col("rank") == k).select(*group, F.col("value").alias("kth"))
            unseen = unseen.join(kth, group, "left").where("kth is null or bound >= kth")
        if found is not None and not unseen.limit(1).count():
            return found
        chosen = unseen.where(F.col("before") < high).select(*group, "bucket")
        scored = entries.withColumn("bucket", bucket).join(chosen, [*group, "bucket"]).where("p > q")
        scored = scored.select(*group, F.col("term").alias("item"), divergence("p", "q").alias("value"))
        scored = scored.unionByName(found.drop("rank")) if found is not None else scored
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = scratch.save(ranked, f"terms_{step}")
        step, low, high = step + 1, high, high * GROWTH


def _pairs(entries: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Each group against every other source of its language: lang, source, item, value."""
    shared = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("held")).where(F.size("held") > 1)
    shared = shared.select("lang", "held", F.explode("held").alias("g")).select("lang", "g", F.explode("held").alias("s")).where("g.source <> s.source")
    shared = shared.select("lang", F.col("g.source").alias("source"), F.col("s.source").alias("item"), F.col("g.p").alias("a"), F.col("g.zero").alias("za"), F.col("s.p").alias("b"), F.col("s.zero").alias("zb"))
    both = divergence("a", "b") - divergence("a", "zb") - divergence("za", "b") + divergence("za", "zb")
    pair = ["lang", "source", "item"]
    total = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    shared = shared.groupBy(*pair).agg(total(both).alias("both"))

    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    counts = entries.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("terms")).join(other, "lang").where("source <> other")
    forth = counts.groupBy("lang", "source", F.col("other").alias("item")).agg(total((divergence("p", "other_zero") - divergence("zero", "other_zero")) * F.col("terms")).alias("forth"))
    back = counts.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(total((divergence("other_zero", "p") - divergence("other_zero", "zero")) * F.col("terms")).alias("back"))
    every = groups.select("lang", "source", "zero", "kept").join(other, "lang").where("source <> other").withColumn("base", divergence("zero", "other_zero").cast("decimal(20,0)") * F.col("kept"))
    every = every.select("lang", "source", F.col("other").alias("item"), "base")
    for part in (shared, forth, back):
        every = every.join(part, pair, "left")
    zero = F.lit(0).cast("decimal(38,0)")
    value = sum((F.coalesce(c, zero) for c in ("both", "forth", "back")), F.col("base"))
    return every.select(*pair, value.cast("long").alias("value"))


def audit(docs: DataFrame, k: int = 200, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per (lang, source): part, item, value and rank. Part ``pair`` is each other source of the language, ``term`` the ``k`` terms most in excess."""
    if k < 1 or least_docs < 1:
        raise ValueError("k and least_docs must be positive")
    scratch = Scratch(docs.sparkSession, "divergence")
    own = pick(docs, lang_col, source_col, text_col).toDF("lang", "source", "text")
    own = own.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own.columns])
    groups, entries = _entries(own, scratch, least_docs)
    pairs = _pairs(entries, groups, scratch).withColumn("part", F.lit("pair"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = _best_terms(entries, scratch, k).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))
