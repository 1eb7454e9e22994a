"""Compiled generations: the catalog of a source, incremental builds, and validation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, policy, text
from tessera.operators import dedup, postings
from tessera.sources import markdown

CATALOG = "path string, document_id string, ordinal long, content_sha256 string, norm_sha256 string, byte_length long, mtime timestamp, first_seen timestamp, last_seen timestamp, tombstone_at timestamp, duplicate_of string, corpus string, retrieval_scope string"


def compile_notes(scanned: DataFrame, source: str) -> DataFrame:
    """Parsed, classified and identified notes of a scan."""
    parsed = markdown.parse_notes(scanned.where("valid_utf8"), compiled=True)
    d = policy.classify(F.col("path"), F.col("fields"), F.col("body"), F.col("title"), F.col("tags"))
    out = parsed.withColumn("_d", d).withColumn("corpus", F.col("_d.corpus")).withColumn("retrieval_scope", F.col("_d.scope")).withColumn("reason", F.col("_d.reason")).drop("_d")
    doc = ids.document_id(F.lit(source), F.col("path"))
    return out.withColumn("document_id", doc).withColumn("version_id", ids.version_id(F.col("document_id"), F.col("content")))


def next_catalog(units: DataFrame, previous: DataFrame, now: datetime) -> DataFrame:
    """The catalog after a build: ordinals and first-seen times stay, missing paths become tombstones.

    A copy points to the first path with the same text, scope and corpus; hidden notes are no copies.
    """
    live = units.select("path", "document_id", "content_sha256", "norm_sha256", "byte_length", "mtime", "corpus", "retrieval_scope")
    ordinals = dedup.stable_ordinals(live, previous)
    shown = live.where("retrieval_scope <> 'never'")
    key = F.concat_ws("\x00", "retrieval_scope", "corpus", "norm_sha256")
    first = shown.groupBy(key.alias("_key")).agg(F.min_by("document_id", "path").alias("_first"))
    copies = shown.withColumn("_key", key).join(first, "_key").where("document_id <> _first").select("path", F.col("_first").alias("duplicate_of"))
    seen = previous.select("path", "first_seen")
    stamp = F.lit(now).cast("timestamp")
    current = live.join(ordinals, "path").join(copies, "path", "left").join(seen, "path", "left")
    current = current.select("path", "document_id", "ordinal", "content_sha256", "norm_sha256", "byte_length", "mtime", F.coalesce("first_seen", stamp).alias("first_seen"), stamp.alias("last_seen"), F.lit(None).cast("timestamp").alias("tombstone_at"), "duplicate_of", "corpus", "retrieval_scope")
    gone = previous.join(live.select("path"), "path", "left_anti").withColumn("tombstone_at", F.coalesce("tombstone_at", stamp)).withColumn("duplicate_of", F.lit(None).cast("string"))
    return current.unionByName(gone.select(*current.columns))


ACTIVE = "tombstone_at is null and duplicate_of is null and retrieval_scope <> 'never'"


def replaced_ordinals(previous: DataFrame, current: DataFrame, *also: str) -> DataFrame:
    """Ordinals (id) whose searchable content, or a column of ``also``, changed, came or went."""
    active = lambda c: c.where(ACTIVE).select(F.col("ordinal").alias("id"), "content_sha256", *also)
    p, c = active(previous), active(current)
    return p.exceptAll(c).unionByName(c.exceptAll(p)).select("id").distinct()


def layers(units: DataFrame, catalog: DataFrame, most: int = 800, overlap: int = 80, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """The tables of a generation: catalog, documents, chunks, postings, temporal and hierarchy.

    All but catalog and temporal hold just what the units given say, which may be those of a delta. ``keep`` may store
    a table that others are made from.
    """
    active = catalog.where(ACTIVE).select("path", "ordinal")
    docs = units.join(active, "path").select("path", "ordinal", "document_id", "version_id", "title", "aliases", "tags", "headings", markdown.links(F.col("content")).alias("links"), "corpus", "retrieval_scope", "content_sha256", "mtime")
    docs = keep("documents", docs)
    parts = markdown.chunks(units.join(active, "path"), "path", "content", most, overlap, "body_start")
    chunk = parts.withColumnRenamed("id", "path").join(docs.select("path", "ordinal", "version_id"), "path")
    span = ids.span_id(F.col("version_id"), F.concat_ws(":", F.col("start_line").cast("string"), F.col("start_col").cast("string")), F.concat_ws(":", F.col("end_line").cast("string"), F.col("end_col").cast("string")))
    chunk = chunk.withColumn("span_id", span).withColumn("chunk_id", ids.chunk_id(F.col("span_id"), F.col("content")))
    chunk = keep("chunks", chunk)
    posted = postings.postings(chunk, "chunk_id", text.lexical_tokens(F.col("content"), compat=True), "ordinal")
    by_doc = postings.roll_up(posted, "ordinal")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return {
        "catalog": catalog, "documents": docs, "chunks": chunk, "chunk_postings": posted, "postings": by_doc.withColumnRenamed("ordinal", "id"),
        "temporal": catalog.where(ACTIVE).select("ordinal", F.col("mtime").alias("modified_at")),
        "hierarchy": docs.select("ordinal", folders.alias("segments"), F.transform("headings", lambda h: h["text"]).alias("headings")),
    }


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of the checks that fail on a generation; empty if it is sound."""
    cat, docs, chunk = tables["catalog"], tables["documents"], tables["chunks"]
    active = cat.where(ACTIVE)
    out = [
        ("duplicate ordinal", cat.groupBy("ordinal").count().where("count > 1")),
        ("duplicate path", cat.groupBy("path").count().where("count > 1")),
        ("active entry without document", active.join(docs, "ordinal", "left_anti")),
        ("document without active entry", docs.join(active, "ordinal", "left_anti")),
        ("content differs", docs.alias("d").join(active.alias("c"), "ordinal").where("d.content_sha256 <> c.content_sha256")),
        ("chunk without document", chunk.join(docs, "ordinal", "left_anti")),
        ("temporal differs", tables["temporal"].select("ordinal").exceptAll(docs.select("ordinal"))),
        ("hierarchy differs", tables["hierarchy"].select("ordinal").exceptAll(docs.select("ordinal"))),
        ("posting without document", tables["postings"].join(docs.select(F.col("ordinal").alias("id")), "id", "left_anti")),
    ]
    found = None
    for name, bad in out:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        found = row if found is None else found.unionByName(row)
    return found.where("n > 0")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def bundle_statistics(catalog: DataFrame, segments: int = 1) -> DataFrame:
    """One row: active documents, tombstones, duplicates and lexical segments of a generation."""
    active = F.col("tombstone_at").isNull() & F.col("duplicate_of").isNull() & (F.col("retrieval_scope") != "never")
    count = lambda c: F.count_if(c)
    return catalog.agg(count(active).alias("active_documents"), count(F.col("tombstone_at").isNotNull()).alias("tombstones"), count(F.col("duplicate_of").isNotNull()).alias("duplicates"), F.lit(segments).alias("lexical_segments"))


def reusable(scanned: DataFrame, units: DataFrame, same_policy: bool) -> tuple[DataFrame, DataFrame]:
    """The files of a scan that need compiling, and the units of an earlier build that stand for the others.

    A unit is reused where path and content hash are the same and nothing of the policy changed.
    """
    if not same_policy:
        return scanned, units.where(F.lit(False))
    now = [c for c in ("mtime",) if c in units.columns and c in scanned.columns]  # a file may be touched only
    kept = units.drop(*now).join(scanned.select("path", "content_sha256", *now), ["path", "content_sha256"]).select(*units.columns)
    return scanned.join(kept.select("path"), "path", "left_anti"), kept


def normalized_documents(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """One document per graph node: missing ones and missing fields get defaults, at most 16 headings, tags without ``#``."""
    empty = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), empty)
    path = F.coalesce("path", F.col("node").cast("string"))
    return nodes.select("node").join(raw, F.col("node") == F.col("id"), "left").select(
        F.col("node").alias("id"), path.alias("path"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.regexp_replace(text.basename(path), r"(?i)\.md$", "")).alias("title"),
        listed("aliases").alias("aliases"), F.transform(listed("tags"), lambda t: F.regexp_replace(t, "^#", "")).alias("tags"), F.slice(listed("headings"), 1, 16).alias("headings"), F.coalesce("content", F.lit("")).alias("content"),
    )


def overview(notes: DataFrame) -> DataFrame:
    """(kind, value, n): notes in all, by corpus, by scope, by exclusion reason, duplicates, and chunks.

    ``notes`` has corpus, retrieval_scope, reason, duplicate (boolean) and chunks (a count).
    """
    shown = F.col("retrieval_scope") != "never"
    one = F.lit(1)
    told = [
        ("notes", F.lit("discovered"), one), ("notes", F.when(shown, "indexed").otherwise("excluded"), one), ("notes", F.when(F.col("duplicate"), "duplicate"), one),
        ("notes", F.when(shown, "chunks"), F.col("chunks")), ("corpus", F.when(shown, F.col("corpus")), one), ("scope", F.when(shown, F.col("retrieval_scope")), one),
        ("excluded", F.when(~shown, policy.reason_bucket(F.col("reason"))), one),
    ]
    facts = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), n.cast("long").alias("n")) for k, v, n in told])
    return notes.select(F.inline(facts)).where("value is not null").groupBy("kind", "value").agg(F.sum("n").alias("n"))
