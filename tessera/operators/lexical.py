"""Lexical search over chunks of notes with metadata and link signals, and related notes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import postings
from tessera.operators.graph import own_checkpoint_dir

# fixed values: weights of the score's parts
FIELDS = {"title": 1.4, "aliases": 1.2, "tags": 1.0, "headings": 0.65, "path": 0.35}
STRONG = ("title", "aliases", "tags")
LEAST_SCORE = 0.2
GRAPH_SHARE = 0.12


#: Folders that stored postings are cut into by term, and stored notes and chunks by id; some GB in one are well.
BUCKETS = 64


def _words(values: str, array: bool) -> Column:
    joined = F.concat_ws(" ", values) if array else F.coalesce(F.col(values), F.lit(""))
    return F.array_distinct(text.lexical_tokens(joined, compat=True))


def _asked(query: str, terms: Sequence[str] | None) -> tuple[list[str], str]:
    """The distinct terms of a query, and the phrase that is looked for."""
    whole = text.query_tokens(query)
    terms = list(dict.fromkeys(terms if terms is not None else whole))
    phrase = " ".join((query if terms == whole and len(terms) == len(query.split()) else " ".join(terms)).lower().split())
    return terms, phrase


def _holds(c: Column, phrase: str) -> Column:
    return text.contains_phrase(c, phrase) if len(phrase) > 1 else F.lit(False)


def _nothing(notes: DataFrame) -> DataFrame:
    return notes.select("id", "path", F.lit(0).alias("chunk"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched_fields")).where(F.lit(False))


def _best(terms: Sequence[str], selective: bool, seen: DataFrame, facts: DataFrame, bodies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best chunk of each admitted note.

    ``seen`` has id, the matched terms m_* of each field, and b0, b1, ... (whether the term is in the note's chunks) of
    notes that hold a term; ``facts`` is one row: notes, n and avgdl of chunks, and df0, df1, ... ``bodies`` adds to
    admitted notes path, exact_meta and their chunks: chunk, exact_body, dl, tf0, tf1, ...
    """
    required, each = min(2, len(terms)), range(len(terms))
    all_meta = F.array_distinct(F.concat(*[F.col(f"m_{f}") for f in FIELDS]))
    seen = seen.select("*", *[(F.coalesce(f"b{i}", F.lit(False)) | F.array_contains(all_meta, t)).alias(f"h{i}") for i, t in enumerate(terms)])
    seen = seen.where(" or ".join(f"h{i}" for i in each))
    held = seen.agg(*[F.sum(F.col(f"h{i}").cast("long")).alias(f"nd{i}") for i in each])
    rare = [(F.lit(selective) & (F.coalesce(f"nd{i}", F.lit(0)) <= F.greatest(F.lit(4), F.ceil(F.col("notes") * 0.02)))).alias(f"rare{i}") for i in each]
    facts = facts.crossJoin(held).select(*facts.columns, *rare)  # one row
    strong = sum((F.size(f"m_{f}") for f in STRONG), F.lit(0)) > 0
    count = sum((F.col(f"h{i}").cast("int") for i in each), F.lit(0))
    selective_hit = F.lit(False)
    for i in each:
        selective_hit = selective_hit | (F.col(f"h{i}") & F.col(f"rare{i}"))
    admitted = seen.crossJoin(F.broadcast(facts)).where((count >= required) | strong | selective_hit)
    rows = bodies(admitted)
    matched, rare_match, bm = F.lit(0), F.lit(False), F.lit(0.0)
    for i, t in enumerate(terms):
        own = (F.col(f"tf{i}") > 0) | F.array_contains(all_meta, t)
        matched = matched + own.cast("int")
        rare_match = rare_match | (own & F.col(f"rare{i}"))
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        bm = bm + F.when(F.col(f"tf{i}") > 0, idf * F.col(f"tf{i}") * 2.2 / (F.col(f"tf{i}") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    strong_note = F.col("exact_meta") | strong | (F.size(all_meta) >= required)
    weight = sum((F.size(f"m_{f}") * w for f, w in FIELDS.items()), F.lit(0.0))
    bonus = F.when(F.col("exact_body"), 1.1).when(F.col("exact_meta"), 1.4).otherwise(0.0)
    fields = F.filter(F.array(*[F.when(F.size(f"m_{f}") > 0, F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    kept = rows.where((matched >= required) | F.col("exact_body") | strong_note | rare_match)
    scored = kept.select("id", "path", "chunk", (bm + weight + bonus).alias("score"), fields.alias("matched_fields")).where(F.col("score") >= LEAST_SCORE)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "chunk")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _named(notes: DataFrame) -> Column:
    """The text that a phrase is looked for in besides chunks: title, aliases and tags, a line each."""
    return F.concat_ws("\n", "title", F.array_join("aliases", "\n"), F.array_join("tags", "\n"))


def search(notes: DataFrame, chunks: DataFrame, query: str, terms: Sequence[str] | None = None, selective: bool = True) -> DataFrame:
    """Best chunk of each admitted note: id, path, chunk, score, matched_fields.

    ``notes`` has id, path, title, aliases, tags, headings (texts); ``chunks`` has id, chunk, content. A note is a
    candidate if it holds two query terms (one, if there is but one), a strong metadata term, or a selective term
    (in at most 2 % of the notes, or 4). A chunk's score is BM25 over all chunks, plus field weights of matched terms,
    plus a bonus for the exact phrase. All texts are compared in NFKC. Reads everything; see :func:`index` for searches
    that do not.
    """
    terms, phrase = _asked(query, terms)
    if not terms:
        return _nothing(notes)
    wanted, each = F.array(*map(F.lit, terms)), range(len(terms))
    kinds = dict(notes.dtypes)
    meta = notes.select("id", "path", *[F.array_intersect(_words(f, kinds[f].startswith("array")), wanted).alias(f"m_{f}") for f in FIELDS], _holds(text.nfkc(_named(notes)), phrase).alias("exact_meta"))
    plain = text.nfkc(F.coalesce("content", F.lit("")))
    body = chunks.select("id", "chunk", plain.alias("_c")).select("id", "chunk", text.lexical_tokens(F.col("_c")).alias("_t"), _holds(F.col("_c"), phrase).alias("exact_body"))
    body = body.select("id", "chunk", "exact_body", F.size("_t").alias("dl"), *[F.size(F.filter("_t", lambda x: x == t)).alias(f"tf{i}") for i, t in enumerate(terms)])
    own_checkpoint_dir(chunks.sparkSession)
    body = body.checkpoint()  # numbers only; each text is read once
    facts = body.where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in each])
    facts = facts.na.fill(0).crossJoin(notes.agg(F.count(F.lit(1)).alias("notes")))
    held = body.groupBy("id").agg(*[F.max(F.col(f"tf{i}") > 0).alias(f"b{i}") for i in each])
    return _best(terms, selective, meta.join(held, "id", "left"), facts, lambda admitted: admitted.join(body, "id"))


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def index(notes: DataFrame, chunks: DataFrame, save: Callable[[str, DataFrame, str], DataFrame], buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Stored tables that searches start from terms with, as notes and chunks of :func:`search`.

    ``save(name, table, column)`` stores a table in folders by a column and gives it back as it is read. Postings are
    in folders by term and sorted by it, so a query reads a few row groups; notes and chunks are in folders by id, so
    the survivors are fetched without a pass over the corpus. Texts are stored in NFKC.
    """
    kinds = dict(notes.dtypes)
    by_id = lambda df: df.withColumn("bucket", _bucket(F.col("id"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "id")
    by_term = lambda df: df.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "term")
    plain = chunks.select("id", "chunk", text.nfkc(F.coalesce("content", F.lit(""))).alias("content"))
    held = plain.withColumn("_t", text.lexical_tokens(F.col("content")))
    stored = {"chunks": save("chunks", by_id(held.select("id", "chunk", F.size("_t").alias("dl"), "content")), "bucket")}
    posted = postings.postings(held, "id", F.col("_t"), "chunk")
    stored["postings"] = save("postings", by_term(posted), "bucket")
    named = notes.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _words(f, kinds[f].startswith("array")).alias("terms")) for f in FIELDS])).alias("x"))
    stored["fields"] = save("fields", by_term(named.select("id", "x.field", F.explode("x.terms").alias("term"))), "bucket")
    stored["notes"] = save("notes", by_id(notes.select("id", "path", text.nfkc(_named(notes)).alias("named"))), "bucket")
    facts = stored["chunks"].where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl")).na.fill(0)
    stored["facts"] = save("facts", facts.crossJoin(stored["notes"].agg(F.count(F.lit(1)).alias("notes"))).withColumn("bucket", F.lit(0)), "bucket")
    return stored


def stored_index(spark: SparkSession, root: str) -> Callable[[str, DataFrame, str], DataFrame]:
    """A ``save`` for :func:`index` that writes under a folder."""

    def save(name: str, df: DataFrame, column: str) -> DataFrame:
        df.write.partitionBy(column).option("parquet.block.size", 8 << 20).parquet(f"{root}/{name}")
        return open_index(spark, root, [name])[name]

    return save


def open_index(spark: SparkSession, root: str, names: Sequence[str] = ("chunks", "postings", "fields", "notes", "facts")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def search_index(stored: dict[str, DataFrame], query: str, terms: Sequence[str] | None = None, selective: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The rows of :func:`search` from stored tables: the query's postings first, then only what they admit.

    ``buckets`` is that of :func:`index`.
    """
    terms, phrase = _asked(query, terms)
    if not terms:
        return _nothing(stored["notes"])
    each = range(len(terms))
    # hashes of constants fold, so no other folder is listed
    there = reduce(lambda a, b: a | b, [F.col("bucket") == _bucket(F.lit(t), buckets) for t in terms])
    of = lambda name: stored[name].where(there & F.col("term").isin(terms))
    counts = [F.max(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    hits = of("postings").groupBy("id", "chunk").agg(*counts)
    facts = stored["facts"].select("n", "avgdl", "notes").crossJoin(hits.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in each]))
    held = hits.groupBy("id").agg(*[F.max(F.col(f"tf{i}") > 0).alias(f"b{i}") for i in each])
    none = F.array().cast("array<string>")
    matched = lambda f: F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("term"))))
    meta = of("fields").groupBy("id").agg(*[matched(f).alias(f"m_{f}") for f in FIELDS])
    seen = meta.join(held, "id", "full").select("id", *[F.coalesce(f"m_{f}", none).alias(f"m_{f}") for f in FIELDS], *[f"b{i}" for i in each])

    def bodies(admitted: DataFrame) -> DataFrame:
        admitted = admitted.withColumn("bucket", _bucket(F.col("id"), buckets))
        notes = stored["notes"].select("bucket", "id", "path", _holds(F.col("named"), phrase).alias("exact_meta"))
        parts = stored["chunks"].select("bucket", "id", "chunk", "dl", _holds(F.col("content"), phrase).alias("exact_body"))
        rows = admitted.join(notes, ["bucket", "id"]).join(parts, ["bucket", "id"]).join(hits, ["id", "chunk"], "left")
        return rows.na.fill(0, [f"tf{i}" for i in each])

    return _best(terms, selective, seen, facts, bodies)


def _dropped(query: str) -> list[str]:
    """Words of a query that were dropped as fillers and may be a note's name."""
    terms = text.query_tokens(query)
    return [w for w in text.plain_tokens(query) if w not in terms and w not in text.SHELL_WORDS]


def search_or_metadata(notes: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """The search; if it finds nothing, notes whose title, alias or tag holds a word that was dropped as a filler."""
    found, dropped = search(notes, chunks, query), _dropped(query)
    if not dropped or not found.isEmpty():
        return found
    wanted, kinds = F.array(*map(F.lit, dropped)), dict(notes.dtypes)
    named = F.lit(False)
    for f in STRONG:
        named = named | (F.size(F.array_intersect(_words(f, kinds[f].startswith("array")), wanted)) > 0)
    return search(notes.where(named), chunks, " ".join(dropped), dropped, selective=False)


def resolve_links(notes: DataFrame, raw: DataFrame) -> DataFrame:
    """(src, dst) of link targets: the path next to the note, then from the root, then a unique file name.

    ``notes`` has id and path; ``raw`` has src (an id) and target. Case and a missing ``.md`` do not matter.
    """
    key = F.lower(F.regexp_replace("path", r"(?i)\.md$", ""))
    by_path = notes.select(F.col("id").alias("dst"), key.alias("key"))
    name = F.element_at(F.split("key", "/"), -1)
    by_name = by_path.withColumn("key", name).groupBy("key").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    target = F.lower(F.regexp_replace(F.regexp_replace("target", r"(?i)\.md$", ""), r"^\./", ""))
    folder = F.regexp_replace(F.lower("path"), r"[^/]*$", "")
    asked = raw.join(notes.select(F.col("id").alias("src"), "path"), "src").select("src", "target", target.alias("t"), folder.alias("folder"))
    tries = asked.select("src", "target", F.posexplode(F.array(F.concat("folder", "t"), F.col("t"))).alias("rank", "key")).join(by_path, "key")
    named = asked.select("src", "target", F.lit(2).alias("rank"), F.element_at(F.split("t", "/"), -1).alias("key")).join(by_name, "key")
    best = tries.unionByName(named).groupBy("src", "target").agg(F.min_by("dst", "rank").alias("dst"))
    return best.where("src <> dst").select("src", "dst").distinct()


def related(links: DataFrame, seed: object, hops: int = 2) -> DataFrame:
    """(id, distance) of notes within so many links of a seed, in either direction."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.where(F.col("src") == F.lit(seed)).select(F.col("dst").alias("id"), F.lit(1).alias("distance"))
    found = near
    for d in range(2, hops + 1):
        near = near.join(both, near["id"] == both["src"]).select(F.col("dst").alias("id"), F.lit(d).alias("distance")).distinct()
        found = found.unionByName(near)
    return found.where(F.col("id") != F.lit(seed)).groupBy("id").agg(F.min("distance").alias("distance"))


def cocitations(links: DataFrame, seeds: Sequence[object]) -> DataFrame:
    """(seed, id, shared): notes that link both to a seed and to another note."""
    x = links.where(F.col("dst").isin(list(seeds))).select("src", F.col("dst").alias("seed"))
    return x.join(links, "src").where("seed <> dst").groupBy("seed", F.col("dst").alias("id")).agg(F.countDistinct("src").alias("shared"))


def graph_scores(notes: DataFrame, links: DataFrame, seeds: Sequence[object]) -> DataFrame:
    """(id, graph_score): the best of a direct link (1), two hops (.55), shared tags (at most .45) and co-citations (at most .7)."""
    out = None
    for s in list(seeds)[:6]:
        hop = related(links, s).select("id", F.when(F.col("distance") == 1, 1.0).otherwise(0.55).alias("g"))
        tags = notes.where(F.col("id") == F.lit(s)).select(F.col("tags").alias("_seed"))  # one row
        shared = notes.where(F.col("id") != F.lit(s)).crossJoin(F.broadcast(tags)).select("id", F.least(F.lit(0.45), 0.2 * F.size(F.array_intersect("tags", "_seed"))).alias("g"))
        cited = cocitations(links, [s]).select("id", F.least(F.lit(0.7), 0.25 * F.col("shared")).alias("g"))
        part = hop.unionByName(shared).unionByName(cited)
        out = part if out is None else out.unionByName(part)
    return out.where("g > 0").groupBy("id").agg(F.max("g").alias("graph_score"))


def rerank(found: DataFrame, notes: DataFrame, links: DataFrame, seeds: Sequence[object], limit: int = 8) -> DataFrame:
    """Search results ordered by ``score * (1 + .12 * graph score)``, with a confidence in percent."""
    scored = found.join(graph_scores(notes, links, seeds), "id", "left").withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))
    combined = F.col("score") * (1 + GRAPH_SHARE * F.col("graph_score"))
    out = scored.withColumn("combined", combined).withColumn("confidence", F.round(100 * (1 - F.exp(-F.col("combined") / 4))).cast("int"))
    return out.orderBy(F.desc("combined"), "path").limit(max(1, min(limit, 20)))


def snippet(content, terms: Sequence[str], most: int = 320):
    """The line with most query terms, with one line before and three after, on one line."""
    lines = F.split(content, "\n")
    wanted = F.array(*map(F.lit, terms))
    hits = F.transform(lines, lambda x: F.size(F.array_intersect(text.lexical_tokens(x), wanted)))
    at = F.array_position(hits, F.array_max(hits)).cast("int")
    start = F.greatest(at - 1, F.lit(1))
    return F.substring(F.trim(F.regexp_replace(F.array_join(F.slice(lines, start, at - start + 4), " "), r"\s+", " ")), 1, most)


def shortest_paths(links: DataFrame, seed: object, depth: int = 2) -> DataFrame:
    """(id, distance, route): a shortest route from a seed in either direction, the least one where there are several."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    start = F.lit(seed).cast(dict(links.dtypes)["src"])
    now = both.where(F.col("src") == start).select(F.col("dst").alias("id"), F.lit(1).alias("distance"), F.array(start, "dst").alias("route"))
    found = now
    for d in range(2, depth + 1):
        step = now.join(both, F.col("id") == F.col("src")).where(F.col("dst") != start)
        now = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("route", F.array("dst"))).alias("route")).select("id", F.lit(d).alias("distance"), "route")
        now = now.join(found.select("id"), "id", "left_anti")
        found = found.unionByName(now)
    return found


def related_notes(notes: DataFrame, links: DataFrame, seed: object, depth: int = 2, limit: int = 12) -> DataFrame:
    """(id, path, title, distance, route, reasons) of notes near a seed: nearest first, then by path; at most 30.

    ``notes`` has id, path, title and tags. Reasons name the distance, and up to three tags that both share.
    """
    own = notes.where(F.col("id") == F.lit(seed)).select(F.col("tags").alias("_own"))  # one row
    near = notes.join(shortest_paths(links, seed, max(1, min(depth, 2))), "id").crossJoin(F.broadcast(own))
    shared = F.filter("_own", lambda t: F.array_contains("tags", t))
    told = F.when(F.size(shared) > 0, F.concat(F.lit("shared tags: "), F.array_join(F.slice(shared, 1, 3), ", ")))
    reasons = F.array_compact(F.array(F.when(F.col("distance") == 1, "directly linked").otherwise("connected through one note"), told))
    return near.select("id", "path", "title", "distance", "route", reasons.alias("reasons")).orderBy("distance", "path").limit(max(1, min(limit, 30)))
