"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and everyone else
as a named user. Turns of role ``system`` are nobody's: they stand in every rendering as they are. Only the
assistant's own words and the closing mark after them count for the loss; headers and other speakers do not.

A rendering is returned turn by turn, with each turn's place in it, so that a conversation of any length is never
gathered in one task: the rows of a perspective, in order of ``segment``, concatenate to its text, and ``loss_start``
and ``loss_end`` are the character positions of what is learned. :func:`assemble` joins them for conversations that
are known to fit in memory.

Defined cases: a null role is the participant ``unknown``; a null text is empty; turns with equal numbers, repeated
rows and null turns (first) are all kept, ordered by turn, role and text; a conversation of system turns only has no
participant and gives no rows; rows whose conv_id is null form one conversation; an empty table gives an empty
table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>\n"
#: Each conversation's turns are numbered in ranges of this many turn numbers, so a long one is no single window.
TURN_RANGE = 256


def rotate(turns: DataFrame) -> DataFrame:
    """One row per conversation, participant (``perspective``) and turn.

    Columns: conv_id, perspective, segment (from 0), turn, speaker, role (assistant, user or system), rendered,
    char_start, char_end, loss_start, loss_end (both equal to char_end where nothing is learned), mask (1 if learned).
    """
    base = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
    ).withColumn("_range", F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(1 << 63))))
    people = base.where(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    me = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(me, "assistant").otherwise("user")
    header = F.concat(F.lit(START), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    seen = (
        base.join(people, base["conv_id"].eqNullSafe(people["conv_id"])).drop(people["conv_id"])
        .withColumn("role", role)
        .withColumn("_header", F.length(header))
        .withColumn("rendered", F.concat(header, F.col("content"), F.lit(END)))
        .withColumn("_size", F.length("rendered").cast("long"))
    )
    key = ["conv_id", "perspective"]
    within = Window.partitionBy(*key, "_range").orderBy(F.col("turn").asc_nulls_first(), "speaker", "content")
    placed = seen.withColumn("_n", F.row_number().over(within)).withColumn("_end", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    totals = seen.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_chars"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"), F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_char0"),
    )
    joined = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_range") == F.col("_r")))
    end = F.col("_char0") + F.col("_end")
    learned = F.col("role") == "assistant"
    return joined.select(
        "conv_id", "perspective",
        (F.col("_row0") + F.col("_n") - 1).cast("int").alias("segment"),
        "turn", "speaker", "role", "rendered",
        (end - F.col("_size")).alias("char_start"), end.alias("char_end"),
        F.when(learned, end - F.col("_size") + F.col("_header")).otherwise(end).alias("loss_start"), end.alias("loss_end"),
        learned.cast("int").alias("mask"),
    )


def assemble(rotated: DataFrame) -> DataFrame:
    """Whole renderings with their learned spans; for conversations that fit in one task's memory only."""
    ordered = F.array_sort(F.collect_list(F.struct("segment", "rendered", "loss_start", "loss_end", "mask")))
    return rotated.groupBy("conv_id", "perspective").agg(ordered.alias("_s")).select(
        "conv_id", "perspective",
        F.array_join(F.col("_s.rendered"), "").alias("text"),
        F.transform(F.filter("_s", lambda s: s["mask"] == 1), lambda s: F.struct(s["loss_start"].alias("start"), s["loss_end"].alias("end"))).alias("spans"),
    )
