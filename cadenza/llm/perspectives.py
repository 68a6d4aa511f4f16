"""Chat formatting from every participant's perspective, with DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as named users;
the mask lists the code-point spans to learn from: the assistant's contents with their end mark.

A conversation may hold any share of all rows: turns are range-partitioned by conversation and turn, ranked within each
partition, and shifted by the totals of the partitions before; every ``part_turns`` turns form one part, the unit
that is gathered. A perspective is one row a part, in order of ``part``; concatenated, the parts are the whole rendering. Spans
count from the part's start.

Defined cases: equal rows (conversation, turn, role, text) are one turn, rows that differ, if only by a null, are turns of their own; rows with the same turn number follow each other by
role, then text; a null turn comes first; a null text is empty; a null or blank role is the speaker "unknown"; system roles are
rendered as system messages and have no perspective; a conversation of system messages alone has one rendering with a null
participant and no mask; an empty table gives an empty result; other columns are ignored. Marks inside texts are broken
by a space after "<", and line breaks in names become spaces, so that no text can open or close a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._common import partitions, stage, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def ranked(turns: DataFrame, part_turns: int) -> DataFrame:
    """conv, speaker, body, at (place within the part) and part; no conversation has to fit in a task."""
    name = F.trim(F.regexp_replace(safe(F.col("role")), r"[\r\n]+", " "))
    rows = turns.select("conv_id", "turn", "role", "text").distinct()  # before names and texts are normalised: rows that differ stay apart
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", F.when(name == "", "unknown").otherwise(name).alias("speaker"), F.coalesce("text", F.lit("")).alias("raw"))
    order = ["turn", "speaker", "raw"]
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), "conv", *order).withColumn("pid", F.spark_partition_id())
    dealt = stage(dealt, "turns")  # range bounds are sampled: keep what they gave
    w = Window.partitionBy("conv", "pid").orderBy(*order)
    dealt = dealt.withColumn("r", F.row_number().over(w).cast("long") - 1)
    counts = dealt.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("shift > 0").select(F.col("conv").alias("c2"), F.col("pid").alias("p2"), "shift")
    rank = F.col("r") + F.coalesce("shift", F.lit(0))
    out = dealt.join(shift, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("pid") == F.col("p2")), "left")
    return out.select("conv", "speaker", safe(F.col("raw")).alias("body"), (rank % part_turns).alias("at"), F.floor(rank / part_turns).alias("part"))


def perspectives(turns: DataFrame, part_turns: int = 256, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, participant, part, n_turns, text, mask (array of start and end), masked_chars."""
    rows = stage(ranked(turns, part_turns), "ranked")
    parts = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("at", "speaker", "body"))).alias("turns"))
    people = rows.groupBy("conv", "speaker").agg(F.lit(1).alias("one")).filter(~F.col("speaker").isin(*system_roles)).select(F.col("conv").alias("c2"), F.col("speaker").alias("participant"))
    seen = parts.join(people, F.col("conv").eqNullSafe(F.col("c2")), "left")

    def head(t: Column) -> Column:
        role = F.when(t["speaker"].isin(*system_roles), "system").when(t["speaker"].eqNullSafe(F.col("participant")), "assistant").otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    learnt = F.coalesce(F.col("participant"), F.lit(""))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], F.lit(CLOSE)).alias("body"), ((t["speaker"] == learnt) & F.col("participant").isNotNull()).alias("own")))
    seen = seen.withColumn("pieces", pieces)
    tail = F.lit("\n")
    ends = F.aggregate("pieces", F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p["head"]) + F.length(p["body"]) + 1)))
    seen = seen.withColumn("ends", ends)
    spans = F.transform(F.filter(F.transform("pieces", lambda p, i: F.struct(p["own"].alias("own"), (F.element_at("ends", (i + 1).cast("int")) + F.length(p["head"])).alias("start"), (F.element_at("ends", (i + 2).cast("int")) - 1).alias("end"))), lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], tail)), "")
    out = seen.select(F.col("conv").alias("conv_id"), "participant", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), spans.alias("mask"))
    return out.withColumn("masked_chars", F.aggregate("mask", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]))


def op5_perspective_rotation(spark, sf_dir):
    """The mask as text, start:end, comma-joined."""
    listed = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", listed)


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn,
         coalesce(nullif(trim(regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '[\r\n]+', ' ', 'g')), ''), 'unknown') AS speaker,
         coalesce(text, '') AS raw
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, raw) - 1 AS rk FROM t),
p AS (SELECT conv_id, speaker AS participant FROM r WHERE speaker <> 'system' GROUP BY ALL),
m AS (
  SELECT r.conv_id, p.participant, rk // 256 AS part, rk, speaker = p.participant AS own,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = p.participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head,
         replace(raw, '<|', '< |') || '<|im_end|>' AS body
  FROM r LEFT JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part ORDER BY rk) AS e FROM m)
SELECT conv_id, participant, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rk) AS text,
       coalesce(string_agg(CAST(e - 1 - length(body) AS BIGINT) || ':' || CAST(e - 1 AS BIGINT), ',' ORDER BY rk) FILTER (WHERE own), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS masked_chars
FROM o GROUP BY conv_id, participant, part
"""
