"""Operator 5, chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; system turns stay
system turns.  The rendering is a table of turn segments with their place in
the rendered text and the span that a loss mask leaves on: the assistant's
words and the end mark.

A conversation may hold a large part of all rows, so it is never gathered in
one task: turns are dealt in order to ranges of about equal size, as a work
table, and each range of a conversation is a block.  Participants are joined
block by block, and places are prefix sums in two steps, inside blocks and
over the blocks' totals.  Neither depends on the turn numbers, which may all
be equal or null; only turns with equal number, speaker and first characters
(``RANGE_CHARS``, which only deal the rows) are never parted.

Marks inside texts and names are parted by a blank and a name's line breaks
become blanks, so nobody's words can open a turn of another speaker.

Defined cases: a null role is the participant ``unknown``; null text is empty;
rows of a null conversation form one conversation; equal turn numbers are
ordered by role, then text; a null turn number comes first; repeated rows are
repeated segments; a conversation of system turns alone has no perspective and
no rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.sources.scratch import keep

#: Characters of a text that are part of the range key, whose sample goes to the driver; the order itself takes whole texts.
RANGE_CHARS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _header(label: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), label, F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" name="), name)), F.lit("\n"))


def _plain(text: Column) -> Column:
    """Text that cannot open or close a turn: a blank parts the characters that begin every mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _plain_name(name: Column) -> Column:
    """A speaker's name in one line, without marks."""
    return F.translate(_plain(name), "\r\n", "  ")


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", neutral: str = "system") -> DataFrame:
    """conv_id, perspective, turn, label, name, segment, start, mask_start, mask_stop; offsets are in characters."""
    rows = turns.select(
        turns[f"`{conv_id}`"].alias("conv_id"),
        turns[f"`{turn}`"].cast("long").alias("turn"),
        F.coalesce(turns[f"`{role}`"], F.lit("unknown")).alias("speaker"),
        _plain(F.coalesce(turns[f"`{text}`"], F.lit(""))).alias("text"),
    )
    ranges = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "speaker", F.substring("text", 1, RANGE_CHARS))
    dealt = keep(ranges.withColumn("block", F.spark_partition_id()), "turns")
    participants = dealt.filter(F.col("speaker") != neutral).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # a conversation has at most as many blocks as there are partitions
    blocks = dealt.select(F.col("conv_id").alias("of_conv"), F.col("block").alias("of_block")).distinct()
    people = blocks.join(participants, F.col("of_conv").eqNullSafe(F.col("conv_id"))).select("of_conv", "of_block", "perspective")
    seen = dealt.join(people, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("of_block")))

    own = F.col("speaker") == F.col("perspective")
    label = F.when(F.col("speaker") == neutral, F.lit(neutral)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when((F.col("speaker") != neutral) & ~own, _plain_name(F.col("speaker")))
    placed = (
        seen.select("conv_id", "perspective", "turn", "speaker", "text", label.alias("label"), name.alias("name"), "block")
        .withColumn("header", _header(F.col("label"), F.col("name")))
        .withColumn("segment", F.concat("header", "text", F.lit(CLOSE)))
    )
    size = F.length("segment").cast("long")
    totals = placed.groupBy("conv_id", "perspective", "block").agg(F.sum(size).alias("chars"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("conv_"), F.col("perspective").alias("perspective_"), F.col("block").alias("block_"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("perspective") == F.col("perspective_")) & (F.col("block") == F.col("block_"))
    trained = F.col("label") == "assistant"
    start = F.col("base") + F.col("within")
    return placed.join(totals, same).select(
        "conv_id", "perspective", "turn", "label", "name", "segment",
        start.alias("start"),
        F.when(trained, start + F.length("header")).alias("mask_start"),
        F.when(trained, start + F.length("segment")).alias("mask_stop"),
    )


def op5_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op5_perspectives": op5_perspectives}
ORACLE = {
    "op5_perspectives": """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS pc, speaker AS perspective FROM c WHERE speaker <> 'system'),
s AS (SELECT conv_id, perspective, turn, speaker, text,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS label,
             CASE WHEN speaker <> 'system' AND speaker <> perspective THEN translate(replace(speaker, '<|', '< |'), chr(13) || chr(10), '  ') END AS name
      FROM c JOIN p ON conv_id IS NOT DISTINCT FROM pc),
h AS (SELECT *, '<|im_start|>' || label || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || chr(10) AS header FROM s),
g AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g)
SELECT conv_id, perspective, turn, label, name, segment, start,
       CASE WHEN label = 'assistant' THEN start + length(header) END AS mask_start,
       CASE WHEN label = 'assistant' THEN start + length(segment) END AS mask_stop FROM o"""
}
