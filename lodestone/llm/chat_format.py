"""Chat formatting by perspective rotation, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered once with that speaker as the assistant, the others as
named users, and a mask over what the assistant says. Long conversations are rendered in blocks of turns, so no task
holds more than a block; a view's blocks, joined in order, are its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _turn(turn: Column, speaker: Column, system: str) -> Column:
    """One rendered turn: head, body, and if the body is the assistant's."""
    role = turn["role"]
    own = role == speaker
    head = F.concat(F.lit(BEGIN), F.when(own, F.lit("assistant")).when(role == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))
    return F.struct(head.alias("head"), F.concat(turn["text"], F.lit(END)).alias("body"), own.alias("own"))


def rotate(conversations: DataFrame, block: int = 64, system: str = "system") -> DataFrame:
    """A row for each conversation, participant and block: conv_id, speaker, block, n_turns, n_own, text, mask.

    ``mask`` lists (start, end), in characters of the block's text, of the bodies that are the speaker's, their end marks
    included. Turns stand in order of (turn, role, text). Every role but ``system`` is a participant; a null role is the
    speaker "unknown", null text is empty, and null turns come after all others in a block of their own, ``-1``. Rows that
    repeat another entirely are rendered once. Rows of a null conv_id are left out; an empty table gives no rows;
    other columns are not read. Block k holds turns k * block to k * block + block - 1.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long"))
    speakers = turns.where(F.col("role") != system).select("conv_id", F.col("role").alias("speaker")).distinct()
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    views = blocks.join(speakers, "conv_id").select("conv_id", "speaker", "block", F.transform("turns", lambda t: _turn(t, F.col("speaker"), system)).alias("t"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    mask = F.aggregate(
        "t",
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["own"], F.array_append(acc["mask"], F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end")))).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"])), "")
    return views.select("conv_id", "speaker", "block", F.size("t").cast("long").alias("n_turns"), F.size(mask).cast("long").alias("n_own"), text.alias("text"), mask.alias("mask"))
