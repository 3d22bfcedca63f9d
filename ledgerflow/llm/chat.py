"""Dialogues seen from each participant: that speaker as the assistant, the others as users
with their names, and what to learn from marked by character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = {"assistant": "<|assistant|>\n", "user": "<|user|>\n", "system": "<|system|>\n"}
CLOSE = "<|end|>\n"
SYSTEM = "system"
UNKNOWN = "unknown"
BLOCK_TURNS = 4096


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation, participant and turn of (conv_id, turn, role, text).

    Returns conv_id, viewer (the participant who is the assistant), nth (long, from 0), speaker,
    part ('assistant', 'user' or 'system'), segment, start, stop (long: where the segment lies
    in the viewer's dialogue, in code points) and mask_start, mask_stop (long: the content to
    learn, null where nothing is learnt). The segments of a viewer in the order of nth are the
    dialogue.

    Every role but ``system`` is a participant; a system turn stays one for every viewer, and a
    conversation of system turns alone has no rows. A null role is a participant named
    'unknown', null text is empty, '<|' inside a text is broken up so that it can't pass for
    markup. Turns are ordered by (turn, speaker, content), null turns first; rows that repeat are
    turns of their own. Null conversation ids are one conversation. Other columns are not read.

    Offsets are added up within blocks of turns and over the blocks, so a conversation that
    holds much of the table is not one task's work.
    """
    own = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"),
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block_turns))
    viewers = own.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("viewer")).distinct()
    seen = own.join(viewers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    part = (
        F.when(F.col("speaker") == SYSTEM, "system").when(F.col("speaker") == F.col("viewer"), "assistant").otherwise("user")
    )
    seen = seen.withColumn("part", part)
    head = F.concat(
        *[F.when(F.col("part") == k, F.lit(v)).otherwise("") for k, v in OPEN.items()],
        F.when(F.col("part") == "user", F.concat("speaker", F.lit(": "))).otherwise(""),
    )
    seen = seen.withColumn("head", head).withColumn("size", F.length("head") + F.length("content") + len(CLOSE))

    keys = ["conv_id", "viewer"]
    blocks = seen.groupBy(*keys, "block").agg(F.sum("size").alias("total"), F.count("*").alias("many"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("viewer").alias("v"), F.col("block").alias("b"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("passed"),
    )
    here = Window.partitionBy(*keys, "block").orderBy(F.asc_nulls_first("turn"), "speaker", "content")
    out = seen.withColumn("stop", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(here))
    out = out.join(
        blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("viewer") == F.col("v")) & (F.col("block") == F.col("b"))
    )
    stop, learnt = F.col("base") + F.col("stop"), F.col("part") == "assistant"
    return out.select(
        "conv_id", "viewer", (F.col("passed") + F.col("row") - 1).alias("nth"), "speaker", "part",
        F.concat("head", "content", F.lit(CLOSE)).alias("segment"), (stop - F.col("size")).alias("start"), stop.alias("stop"),
        F.when(learnt, stop - F.col("size") + F.length("head")).alias("mask_start"), F.when(learnt, stop - len(CLOSE)).alias("mask_stop"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """(conv_id, viewer, text, masks array<struct<start,stop>>) from ``rotate``, for
    conversations of a size that fits one row."""
    rows = F.sort_array(F.collect_list(F.struct("nth", "segment", "mask_start", "mask_stop")))
    return segments.groupBy("conv_id", "viewer").agg(rows.alias("rows")).select(
        "conv_id", "viewer", F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("text"),
        F.transform(
            F.filter("rows", lambda r: r["mask_start"].isNotNull()), lambda r: F.struct(r["mask_start"].alias("start"), r["mask_stop"].alias("stop"))
        ).alias("masks"),
    )


SQL = f"""
WITH own AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '{UNKNOWN}') AS speaker,
           replace(coalesce(text, ''), '<|', '< |') AS content
    FROM conversations
), viewers AS (SELECT DISTINCT conv_id, speaker AS viewer FROM own WHERE speaker <> '{SYSTEM}'),
seen AS (
    SELECT o.*, v.viewer, CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = viewer THEN 'assistant' ELSE 'user' END AS part
    FROM own o JOIN viewers v ON o.conv_id IS NOT DISTINCT FROM v.conv_id
), laid AS (
    SELECT *, CASE part WHEN 'assistant' THEN '<|assistant|>' || chr(10) WHEN 'user' THEN '<|user|>' || chr(10) || speaker || ': '
                        ELSE '<|system|>' || chr(10) END AS head,
           row_number() OVER w - 1 AS nth
    FROM seen WINDOW w AS (PARTITION BY conv_id, viewer ORDER BY turn NULLS FIRST, speaker, content)
), placed AS (
    SELECT *, CAST(sum(length(head) + length(content) + 8) OVER (PARTITION BY conv_id, viewer ORDER BY nth) AS BIGINT) AS stop
    FROM laid
)
SELECT conv_id, viewer, CAST(nth AS BIGINT) AS nth, speaker, part, head || content || '<|end|>' || chr(10) AS segment,
       stop - length(head) - length(content) - 8 AS start, stop,
       CASE WHEN part = 'assistant' THEN stop - length(content) - 8 END AS mask_start,
       CASE WHEN part = 'assistant' THEN stop - 8 END AS mask_stop
FROM placed
"""
