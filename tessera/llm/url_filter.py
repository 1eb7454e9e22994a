"""URL rules by hashed expressions, with DataFrame functions only.

A URL's host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower
case; its path goes on to the next ``?``, ``#`` or the end. Each URL is expanded into host suffixes (at label
bounds) joined with path prefixes. Suffixes are taken at the label counts, and prefixes at the lengths, that occur in
the rules, so an expression is made for every rule that could fit and for nothing else, however long the URL is.
Expressions meet the rules on the first four bytes of their SHA-256; the whole digest then confirms the match, and
the longest rule wins (ties: the longer host).

Defined cases: a URL that is null or has no ``://`` has an empty host and path and fits no rule; a URL that fits no
rule gets ``default``; repeated rows are judged one by one; an empty table gives an empty table; no rules at all give
``default`` everywhere. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their text, digests and measures; the host has no trailing dot or slash."""
    rule = F.concat("host", "path")
    digest = F.sha2(rule, 256)
    return rules.select(
        rule.alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("host_length"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        digest.alias("digest"),
        F.substring(digest, 1, 8).alias("short"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, winning rule (null if none fits) and verdict of every row.

    ``rules`` has host, path and verdict. Only the distinct label counts and path lengths of the rules come to the
    driver; their number is bounded by the longest host and path of a rule.
    """
    compiled = compile_rules(rules)
    shape = compiled.agg(F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("path_length")).alias("lengths")).first()
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    labels, lengths = shape["labels"] or [], shape["lengths"] or []
    parts = F.split("host", r"\.")
    suffixes = F.filter(F.transform(F.array(*map(F.lit, labels)) if labels else F.array().cast("array<int>"), lambda n: F.when(n <= F.size(parts), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))), lambda s: s.isNotNull())
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    hashed = F.transform(made, lambda e: F.sha2(e, 256))
    expressions = rows.select("*", F.explode_outer(hashed).alias("_digest")).withColumn("_short", F.substring("_digest", 1, 8))
    met = expressions.join(compiled, F.col("_short") == F.col("short"), "left")
    # the short hash only proposes a rule; the whole digest decides
    best = F.max(F.when(F.col("_digest") == F.col("digest"), F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), F.col("rule"), F.col("rule_verdict")))).alias("_best")
    return met.groupBy("_row", "page_id", "host", "path").agg(best).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))
