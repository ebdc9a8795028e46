"""Chat formatting: every participant's view of a conversation, without Python.

For each participant (a distinct role of the conversation but ``system``) the dialogue is rendered with that
speaker as the assistant and the others as users that carry their names; the mask is 1 on the
assistant's turns and 0 on the others'. Turns of ``system`` are nobody's: they stand in every view as system turns, with a mask of 0,
and a conversation of them alone has one view, of which the perspective is null. The rows of the result are the turns of the views: a
conversation of any length stays spread over tasks, so a hot one is never gathered. ``assembled``
joins the turns of a view into texts with the spans of their masks, one for every ``part_turns`` turn numbers, so that a row
holds what has these numbers and no more.

The participants come from an aggregation that is combined before its shuffle; the join that turns
the views is an equi-join on the conversation, which adaptive execution can split where it is skewed.

Texts and names can't forge a turn: ``<|`` in them is rendered as ``<\\|``, and a line end in a name as a blank.

Defined results: a null role is the participant "unknown", a null text an empty turn, a null turn sorts
first and makes a part of its own; rows without conv_id form one conversation; repeated rows are rendered each; a
monologue has one view; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, PART_TURNS = "system", 64


def unmarked(text: Column) -> Column:
    """The text without marks of turns."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def turn_text(role: Column, name: Column, text: Column) -> Column:
    """One turn as it is rendered: the assistant by its role, a user with the name."""
    return F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"), text, F.lit(CLOSE))


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, mask: one row per turn of each view."""
    name = unmarked(F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), "[\r\n]", " "))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), name.alias("name"), unmarked(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    people = turns.groupBy("conv_id", "name").agg(F.lit(1).alias("one"))
    named = people.where(F.col("name") != SYSTEM).select("conv_id", F.col("name").alias("perspective"))
    only_system = people.groupBy("conv_id").agg(F.max(F.col("name") != SYSTEM).alias("any")).where(~F.col("any")).select("conv_id", F.lit(None).cast("string").alias("perspective"))
    views = named.unionByName(only_system)
    t, v = turns.alias("t"), views.alias("v")
    both = t.join(v, F.col("t.conv_id").eqNullSafe(F.col("v.conv_id")))
    role = F.when(F.col("t.name") == SYSTEM, F.lit(SYSTEM)).when(F.col("t.name") == F.col("v.perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    return both.select(
        "t.conv_id", "v.perspective", "t.turn", role.alias("role"), "t.name",
        turn_text(role, F.col("t.name"), F.col("t.text")).alias("rendered"), (role == "assistant").cast("int").alias("mask"),
    )


def assembled(views: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, text, spans: views in parts, each with the (start, end) of what the mask covers."""
    lines = F.array_sort(F.collect_list(F.struct("turn", "name", "rendered", "mask"))).alias("lines")
    ends = F.aggregate("lines", F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x["rendered"]))))
    spans = F.filter(F.transform("lines", lambda x, i: F.struct((F.get("ends", i) - F.length(x["rendered"])).alias("start"), F.get("ends", i).alias("end"), x["mask"].alias("mask"))), lambda s: s["mask"] == 1)
    return (
        views.groupBy("conv_id", "perspective", F.floor(F.col("turn") / part_turns).alias("part")).agg(lines).withColumn("ends", ends)
        .select("conv_id", "perspective", "part", F.array_join(F.transform("lines", lambda x: x["rendered"]), "").alias("text"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, replace(regexp_replace(coalesce(role, 'unknown'), '[\r\n]', ' ', 'g'), '<|', '<\|') AS name, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'
      UNION ALL SELECT conv_id, NULL FROM t GROUP BY conv_id HAVING bool_and(name = 'system')),
b AS (SELECT t.*, v.perspective, CASE WHEN t.name = 'system' THEN 'system' WHEN t.name = v.perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id)
SELECT conv_id, perspective, turn, role, name,
  '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
  CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS mask FROM b
"""
