"""The engine's inputs derived from the driver's tables, in Spark and in SQL.

Records are documents: id, source, path ``source/lang/id.md``, title (first line), hierarchy [source, lang], a scope and
project by id, a time by id. ``RECORDS_SQL`` defines the same view for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.session import table

RECORDS_SQL = """records AS (
  SELECT doc_id AS id, source AS source_id, doc_id AS document_id, source || '/' || lang || '/' || doc_id || '.md' AS path,
         string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS content, [source, lang] AS hierarchy, [lang] AS tags,
         CASE doc_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'project' WHEN 2 THEN 'reference' ELSE 'history' END AS retrieval_scope,
         CASE WHEN doc_id % 4 = 1 AND doc_id % 3 > 0 THEN 'p' || (doc_id % 3) END AS project_id,
         CASE WHEN doc_id % 11 > 0 THEN TIMESTAMP '2020-01-01' + to_hours(CAST(doc_id % 50000 AS BIGINT)) END AS modified_at
  FROM documents)"""

TOKENS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    scope = F.element_at(F.array(*map(F.lit, ("default", "project", "reference", "history"))), (i % 4 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    return d.select(
        i.alias("id"), F.col("source").alias("source_id"), i.alias("document_id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), i.cast("string"), F.lit(".md")).alias("path"),
        F.element_at(F.split(text, "\n"), 1).alias("title"), text.alias("content"), F.array("source", "lang").alias("hierarchy"), F.array("lang").alias("tags"),
        F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("heading"), scope.alias("retrieval_scope"),
        F.when((i % 4 == 1) & (i % 3 > 0), F.concat(F.lit("p"), (i % 3).cast("string"))).alias("project_id"),
        F.when(i % 11 > 0, F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 50000 as int))").cast("timestamp")).alias("modified_at"),
    )


LINKS_SQL = """links AS (
  SELECT DISTINCT page_id AS src, CAST(hash_to AS BIGINT) AS dst FROM (
    SELECT page_id, page_id % 7 * 13 % 97 AS hash_to FROM pages
    UNION ALL SELECT page_id, (page_id * 31 + 7) % 101 FROM pages)
  WHERE page_id <> hash_to)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed link table over pages, by arithmetic on their ids."""
    p = table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id")
    both = p.select(i.alias("src"), (i % 7 * 13 % 97).alias("dst")).unionByName(p.select(i.alias("src"), ((i * 31 + 7) % 101).alias("dst")))
    return both.where("src <> dst").distinct()


EDGES_SQL = """edges AS (
  SELECT least(l_partkey % 500, l_suppkey + 1000) AS src, greatest(l_partkey % 500, l_suppkey + 1000) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem GROUP BY 1, 2)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected weighted graph of part groups and suppliers by shared order lines."""
    lines, x, y = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 500, F.col("l_suppkey") + 1000
    ends = lines.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).repartition(graph.parts(spark, lines.count()), "src", "dst")
    return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
