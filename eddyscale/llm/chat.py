"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, the others as named users and system turns as they are.  The loss mask covers what
the speaker says, with the end marker: spans of code points in the rendered text.

A perspective is one rendering, whose text may come in parts: ``part_start`` says where a part's
text begins in the whole rendering, and the spans of the mask count from the beginning of the
whole, so the parts joined in order with their spans are what one row would hold.

Scale: a conversation's turns meet in parts of ``per_part`` turn numbers each, so a group stays
bounded however long a conversation grows.  Only conversations of several parts are measured
first, by one number for each part and speaker.  Participants are gathered with map-side
combining.

Defined results: turns are ordered by number, role and text, null numbers just before 0; a null role
speaks as ``unknown`` and isn't a participant; null texts are empty, long ones whole; repeated
turns stay; a conversation without participants gives no rows; a null conversation id is a
conversation; control markers within names and contents are broken by a space; an empty table
gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, pieces

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
_FORM = "conv_id {conv}, speaker string, part long, part_start long, text string, mask_starts array<long>, mask_ends array<long>, n_turns long, n_masked long"


def plain(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def render(turns: list[dict], speaker: str) -> tuple[str, list[int], list[int]]:
    out, at, starts, ends = [], 0, [], []
    for turn in turns:
        role = turn["role"]
        if role == speaker:
            head = f"{START}assistant\n"
        elif role == SYSTEM:
            head = f"{START}system\n"
        else:
            head = f"{START}user name={plain(role or 'unknown').replace(chr(10), ' ')}\n"
        body = plain(turn["text"]) + END
        out.append(f"{head}{body}\n")
        if role == speaker:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(out[-1])
    return "".join(out), starts, ends


def _rotate(batches):
    for batch in pieces(batches, rows=500):
        rows = []
        for row in batch.to_pylist():
            before = {x["speaker"]: x["before"] for x in row["starts"] or ()}
            for speaker in row["speakers"]:
                text, starts, ends = render(row["turns"], speaker)
                at = before.get(speaker, 0)
                rows.append((row["conv_id"], speaker, row["part"], at, text, [at + x for x in starts], [at + x for x in ends], len(row["turns"]), sum(ends) - sum(starts)))
        kinds = [batch.schema.field("conv_id").type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv_id", "speaker", "part", "part_start", "text", "mask_starts", "mask_ends", "n_turns", "n_masked"])


def _lengths(batches):
    for batch in pieces(batches, rows=500):
        rows = [(row["conv_id"], speaker, row["part"], len(render(row["turns"], speaker)[0])) for row in batch.to_pylist() for speaker in row["speakers"]]
        kinds = [batch.schema.field("conv_id").type, pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv_id", "speaker", "part", "chars"])


def _starts(both: DataFrame, turns: DataFrame, conv: str, scratch: Scratch) -> DataFrame:
    """(c, p, starts): of each part of a conversation of several, where it starts for each speaker."""
    spans = turns.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"))
    spans = broadcast_if(scratch.save(spans, "long"), F.lit(1), 500_000)
    lengths = both.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").mapInArrow(_lengths, f"conv_id {conv}, speaker string, part long, chars long")
    so_far = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.withColumn("before", F.coalesce(F.sum("chars").over(so_far), F.lit(0)))
    before = before.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.collect_list(F.struct("speaker", "before")).alias("starts"))
    return broadcast_if(scratch.save(before, "starts"), 1 + 2 * F.size("starts"), 1_000_000)


def rotate(conversations: DataFrame, per_part: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, speaker, part, part_start, text, mask_starts, mask_ends, n_turns, n_masked."""
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    conv = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / per_part), F.lit(0)).cast("long"))
    speakers = turns.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).groupBy(F.col("conv_id").alias("s")).agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("s"))).select("conv_id", "part", "speakers", "turns")
    starts = _starts(both, turns, conv, scratch)
    both = both.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select("conv_id", "part", "speakers", "turns", "starts")
    return both.mapInArrow(_rotate, _FORM.format(conv=conv))


def report(conversations: DataFrame) -> DataFrame:
    return rotate(conversations)


#: The same rows by string aggregation.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role,
         replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body, coalesce(text, '') AS raw, text IS NULL AS no_text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT t.conv_id, p.speaker, coalesce(CAST(floor(t.turn / 512.0) AS BIGINT), 0) AS part, t.turn, t.role, t.raw, t.no_text, t.body,
         '<|im_start|>' || CASE WHEN t.role = p.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
           ELSE 'user name=' || replace(replace(coalesce(t.role, 'unknown'), '<|', '< |'), chr(10), ' ') END || chr(10) AS head,
         coalesce(t.role = p.speaker, FALSE) AS own
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, speaker ORDER BY part, turn NULLS FIRST, role NULLS FIRST, no_text DESC, raw
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM r)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(min(start) AS BIGINT) AS part_start,
       string_agg(head || body || chr(10), '' ORDER BY start) AS text,
       coalesce(list(CAST(start + length(head) AS BIGINT) ORDER BY start) FILTER (WHERE own), []) AS mask_starts,
       coalesce(list(CAST(start + length(head) + length(body) AS BIGINT) ORDER BY start) FILTER (WHERE own), []) AS mask_ends,
       count(*) AS n_turns, CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, speaker, part
"""
