"""A corpus pipeline of four stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Documents that the quality classifier rejects go; one document of each near-duplicate component stays; byte strings
that repeat an earlier document are cut out of the texts; what is left is packed into sequences. All stages but the
last return the columns of ``documents``. Each stage's result is written as Parquet and read again as the next one's
input, so every stage reads stored data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, packing, quality, suffix_dedup
from tessera.llm.common import Scratch
from tessera.llm.queries import PACKING_VOCABULARY, vocabulary
from tessera.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the labels are those of the corpus."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of near duplicates."""
    kept = jaccard.keep_one(docs, carry=("lang", "source", "n_chars"))
    return kept.withColumn("n_chars", F.col("n_chars").cast("long")).select(*COLUMNS)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur earlier; n_chars counts what is left."""
    cut = suffix_dedup.remove_repeats(docs, keep_text=True, carry=["lang", "source"])
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece of a document."""
    return packing.pack_documents(docs, vocabulary(PACKING_VOCABULARY))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeat_stage), ("packing", packing_stage)]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
