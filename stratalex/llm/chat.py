"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and the others as named users; turns of ``SYSTEM`` roles stay system turns and are nobody's
perspective. Only the assistant's own words and their end mark are trained on. A rendering is a run
of segments, a row each, with its place and its code point offsets in the rendered dialogue, so a
conversation of any length never has to fit into one row; ``assemble`` joins the segments of dialogues
known to be short.

Offsets are prefix sums in two levels, inside blocks and over blocks. Blocks are the ranges into which all turns are dealt in their
order, so a conversation that holds a large part of all rows is spread over many windows, whatever its turns are numbered like.

Defined results: speakers are told apart by their role as it is, and named in a rendering with whatever could break a mark or merge two names
(white space, ``<``, ``>``, ``|``, ``%``) as ``%`` and its hexadecimal code; a null role is a speaker of its own, who has no name; turns are ordered by turn (null
first), role (null first) and text, repeated rows count each; a null text is empty; a very long text is one segment; rows without conv_id form a conversation of their own; a
conversation of system turns alone has no rendering; ``<|`` inside a text is broken up, so no text
forges a mark; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SYSTEM = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What is written otherwise in a name; the first is the mark of that itself.
ESCAPED = "%<>| \t\n\r\x0b\x0c"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def shown(role: Column) -> Column:
    """A role as a name in a rendering; different roles have different names."""
    for c in ESCAPED:
        role = F.replace(role, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return role


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, block: the turns in their order, dealt into ranges; written, so that the blocks stay what they are."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stored(rows.repartitionByRange("conv_id", "turn", "role", "text").withColumn("block", F.spark_partition_id()), "turns")


def rotate(conversations: DataFrame, system: tuple = SYSTEM) -> DataFrame:
    """conv_id, speaker, place, turn, role, name, segment, char_start, char_end, train_start, train_end.

    A row for each participant and turn; train_start and train_end are null outside the speaker's turns.
    """
    rows = turns(conversations)
    is_system = F.coalesce(F.col("role").isin(*system), F.lit(False))
    people = rows.where(~is_system).select(F.col("conv_id").alias("p_conv"), F.col("role").alias("speaker")).distinct()
    # a turn's size depends on whose turn it is for the speaker, not on who the speaker is
    head = lambda kind, name: F.concat(F.lit(f"{OPEN}{kind}"), name, F.lit("\n"))
    nothing = F.lit("")
    as_other = F.when(is_system, head("system", nothing)).otherwise(head("user", F.coalesce(F.concat(F.lit(" name="), shown(F.col("role"))), nothing)))
    rows = rows.withColumn("is_system", is_system).withColumn("other", as_other).withColumn("plain", _plain(F.col("text")))
    each = rows.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    own = ~F.col("is_system") & F.col("role").eqNullSafe(F.col("speaker"))
    each = each.withColumn("own", own).withColumn("head", F.when(F.col("own"), head("assistant", nothing)).otherwise(F.col("other"))).drop("other")
    size = F.char_length("head") + F.char_length("plain") + len(CLOSE) + 1
    each = each.withColumn("size", size.cast("long"))
    by = ["conv_id", "speaker"]
    blocks = each.groupBy(*by, "block").agg(F.sum("size").alias("b_size"), F.count(F.lit(1)).alias("b_rows"))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("speaker").alias("b_speaker"), F.col("block").alias("b_block"), F.coalesce(F.sum("b_size").over(before), zero).alias("at"), F.coalesce(F.sum("b_rows").over(before), zero).alias("nth"))
    inside = Window.partitionBy(*by, "block").orderBy("turn", "role", "text")
    each = each.withColumn("place", F.row_number().over(inside).cast("long") - 1).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = each.join(blocks, F.expr("conv_id <=> b_conv and speaker <=> b_speaker and block = b_block"))
    start = F.col("at") + F.col("upto") - F.col("size")
    as_role = F.when(F.col("is_system"), "system").when(F.col("own"), "assistant").otherwise("user")
    return out.select(
        "conv_id", "speaker", (F.col("nth") + F.col("place")).alias("place"), "turn", as_role.alias("role"),
        F.when(as_role == "user", F.col("role")).alias("name"),
        F.concat("head", "plain", F.lit(CLOSE + "\n")).alias("segment"),
        start.alias("char_start"), (start + F.col("size")).alias("char_end"),
        F.when(F.col("own"), start + F.char_length("head")).alias("train_start"), F.when(F.col("own"), start + F.col("size") - 1).alias("train_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, speaker, dialogue, mask: whole renderings, for conversations that fit into a row."""
    parts = segments.groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("place", "segment", F.col("train_start").alias("start"), F.col("train_end").alias("end")))).alias("p"))
    return parts.select("conv_id", "speaker", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("dialogue"), F.transform(F.filter("p", lambda x: x["start"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("mask"))
