"""Chat formatting by multi-party perspective rotation, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Turns in one rendered row; longer dialogues come in parts, so that no row or group is unbounded.
PART_TURNS = 512
SYSTEM = "system"
NOBODY = "unknown"


def _said(speaker: Column, me: Column, text: Column) -> tuple[Column, Column]:
    """The header of a turn and its whole rendering, from the perspective of me."""
    head = F.when(speaker == me, F.lit("<|assistant|>\n")).when(speaker == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    return head, F.concat(head, text, F.lit("<|end|>\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, part, me, n_turns, rendered, mask): each dialogue once for each participant.

    me is rendered as the assistant, the system's turns as such and all others as users with their names.
    mask has the spans (start, end) of what me says with its end mark, in code points of rendered; a model
    is trained on those alone. Turns are ordered by number, then speaker and text; nulls count as turn 0,
    the speaker unknown and an empty text. Repeated rows are all rendered. A part holds the turns of one
    run of part_turns numbers. The system takes no part; a dialogue of it alone has no rows. Other columns
    are not looked at.
    """
    own = turns.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col), F.lit(0)).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit(NOBODY)).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    parts = own.withColumn("part", F.floor(F.col("turn") / part_turns)).groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("said"))
    people = own.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("me")).distinct()
    pairs = parts.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(state: Column, s: Column) -> Column:
        head, whole = _said(s["speaker"], F.col("me"), s["text"])
        end = (state["at"] + F.length(whole)).cast("int")
        span = F.struct((state["at"] + F.length(head)).cast("int").alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(s["speaker"] == F.col("me"), F.concat(state["mask"], F.array(span))).otherwise(state["mask"]).alias("mask"))

    rendered = F.array_join(F.transform("said", lambda s: _said(s["speaker"], F.col("me"), s["text"])[1]), "")
    return pairs.select("conv", "part", "me", F.size("said").alias("n_turns"), rendered.alias("rendered"), F.aggregate("said", start, step)["mask"].alias("mask"))


def op10_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    found = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select(F.col("conv").alias("conv_id"), F.col("part").cast("long").alias("part"), F.col("me").alias("participant"), F.col("n_turns").cast("long").alias("n_turns"), "rendered", mask.alias("mask"))


ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id, CAST(coalesce(turn, 0) AS BIGINT) AS turn, coalesce(role, '{NOBODY}') AS speaker, coalesce(text, '') AS said
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS me FROM own WHERE speaker <> '{SYSTEM}'),
each AS (
  SELECT o.conv_id, CAST(floor(o.turn / {PART_TURNS}.0) AS BIGINT) AS part, p.me, o.turn, o.speaker, o.said,
         CASE WHEN o.speaker = p.me THEN '<|assistant|>' || chr(10)
              WHEN o.speaker = '{SYSTEM}' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || o.speaker || '|>' || chr(10) END AS head
  FROM own o JOIN people p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS whole,
         sum(length(head || said) + 8) OVER (PARTITION BY conv_id, part, me ORDER BY turn, speaker, said
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till
  FROM each)
SELECT conv_id, part, me AS participant, count(*) AS n_turns,
       string_agg(whole, '' ORDER BY turn, speaker, said) AS rendered,
       coalesce(string_agg(CAST(till - length(said) - 8 AS VARCHAR) || ':' || CAST(till - 1 AS VARCHAR), ','
                           ORDER BY turn, speaker, said) FILTER (WHERE speaker = me), '') AS mask
FROM placed GROUP BY conv_id, part, me
"""
