"""Multi-party perspective rotation of conversations; DataFrame functions only.

Every participant of a conversation gets the dialogue as one training sample seen
from its side: its own turns become ``assistant`` turns with loss, everybody else's
become ``user`` turns that carry the speaker's name, system turns stay ``system``.
A sample is a sequence of segments, one row each, that together are its text: row
order ``seq``, place ``char_start``, and for segments with loss the span
[mask_start, mask_end) of the sample's characters to train on (the content and its
end mark, not the header). Segments instead of one string per sample keep memory
bounded for conversations of any length.

Places are prefix sums in two levels: within blocks of BLOCK turn numbers, then
over the blocks' totals, so a conversation that holds much of the table is spread
over tasks.

Cases: a null or empty role is the participant ``unknown``; a null text is empty; a
null conv_id is a conversation of its own; turns of equal number follow each other
by speaker and text, null numbers first; repeated rows are repeated turns. A
conversation of system turns only has no participant and no sample. The marks'
opening ``<|`` inside names and texts is written ``< |``; white space in a name, line
breaks included, is one space. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
SYSTEM = "system"
UNKNOWN = "unknown"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _name(c: Column) -> Column:
    """A speaker's name on one line, so that it can't open another header."""
    return F.trim(F.regexp_replace(_plain(c), r"[\s\u0085\u2028\u2029]+", " "))


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (conv_id, perspective, seq); see the module's text."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(_name(F.col("role")), F.lit("")), F.lit(UNKNOWN)).alias("speaker"),
        _plain(F.coalesce("text", F.lit(""))).alias("content"),
    )
    sides = turns.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when((F.col("speaker") == SYSTEM) | own, "").otherwise(F.concat(F.lit(" name="), F.col("speaker")))
    rows = turns.join(sides, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        role.alias("chat_role"),
        F.concat(F.lit("<|im_start|>"), role, name, F.lit("\n")).alias("header"),
        F.concat("content", F.lit("<|im_end|>\n")).alias("body"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-1) - F.lit(1 << 60)).alias("_block"),
    )
    rows = rows.withColumn("_len", F.length("header") + F.length("body").cast("long"))
    inside = Window.partitionBy("conv_id", "perspective", "_block").orderBy("turn", "speaker", "body")
    placed = rows.withColumns(
        {"_rank": F.row_number().over(inside), "_end": F.sum("_len").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    )
    totals = rows.groupBy("conv_id", "perspective", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum("_len").alias("_chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("conv_id").alias("_c"),
        F.col("perspective").alias("_p"),
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_c0"),
    )
    met = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_block") == F.col("_b"))
    start = F.col("_c0") + F.col("_end") - F.col("_len")
    loss = F.col("chat_role") == "assistant"
    return placed.join(bases, met).select(
        "conv_id",
        "perspective",
        (F.col("_n0") + F.col("_rank") - 1).alias("seq"),
        "turn",
        "speaker",
        "chat_role",
        F.concat("header", "body").alias("segment"),
        start.alias("char_start"),
        loss.alias("loss"),
        F.when(loss, start + F.length("header")).alias("mask_start"),
        F.when(loss, start + F.col("_len")).alias("mask_end"),
    )


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn,
         coalesce(nullif(trim(regexp_replace(replace(role, '<|', '< |'), '[\s\x0B\x{85}\x{2028}\x{2029}]+', ' ', 'g')), ''), 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations),
sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
named AS (
  SELECT t.conv_id, perspective, turn, speaker,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role, content
  FROM turns t JOIN sides s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
parts AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header,
         content || '<|im_end|>' || chr(10) AS body
  FROM named),
placed AS (
  SELECT *, length(header) + length(body) AS len,
         row_number() OVER w - 1 AS seq,
         CAST(sum(length(header) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM parts
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, seq, turn, speaker, chat_role, header || body AS segment, char_end - len AS char_start,
       chat_role = 'assistant' AS loss,
       CASE WHEN chat_role = 'assistant' THEN char_end - length(body) END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN char_end END AS mask_end
FROM placed
"""
