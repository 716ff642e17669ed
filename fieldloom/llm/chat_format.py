"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with
that participant as the assistant and every other one as a named user.  The
rendering comes in segments, one a turn and perspective, each with its place in
the rendered dialogue and the span whose tokens are trained on (the content of
the assistant's turns, end mark included); a conversation of any size is thus
never gathered in one place.  ``dialogues`` joins the segments of a conversation.

DataFrame functions only.  Turns are in order of (turn, role, text).  Offsets are
prefix sums in two levels: within chunks of ``CHUNK`` turn numbers, then over
chunk totals, so that a conversation with very many turns is spread.  Defined
results: a null turn comes first; a null role is the participant ``unknown``, a
null text is empty; equal (conversation, turn, role, text) rows are one turn
that was logged ``copies`` times and is rendered once; a null conversation id is
a conversation of its own; an empty table gives an empty result; extra columns
are ignored.  Speakers whose names differ only in white space or ``<>|`` render
under one name but stay apart as perspectives; marks inside a text are not
escaped.  Turns of one number share a chunk, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The marks of the template.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
ASSISTANT, USER, UNKNOWN = "assistant", "user", "unknown"
#: Turn numbers that share a chunk.
CHUNK = 256


def turns_of(chats: DataFrame, conv_col: str, turn_col: str, speaker_col: str, text_col: str) -> DataFrame:
    return (
        chats.select(
            chats[conv_col].alias("conv_id"),
            chats[turn_col].cast("long").alias("turn"),
            F.coalesce(chats[speaker_col], F.lit(UNKNOWN)).alias("speaker"),
            F.coalesce(chats[text_col], F.lit("")).alias("text"),
        )
        .groupBy("conv_id", "turn", "speaker", "text")
        .agg(F.count("*").alias("copies"))
    )


def head_of(speaker: Column, perspective: Column) -> Column:
    """What stands before a turn's content."""
    mine = F.lit(f"{START}{ASSISTANT}{BREAK}")
    other = F.concat(F.lit(f"{START}{USER} name="), F.regexp_replace(speaker, r"[\s<>|]+", "_"), F.lit(BREAK))
    return F.when(speaker == perspective, mine).otherwise(other)


def rotate(
    chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, perspective, turn, speaker, copies, segment, start, length, mask_start, mask_length)``.

    start, length, mask_start: code points from the start of the rendered
    dialogue; mask_length is 0 for a turn that isn't the perspective's.
    """
    scratch = Scratch(chats.sparkSession)
    turns = scratch.keep(turns_of(chats, conv_col, turn_col, speaker_col, text_col), "chat-turns")
    people = turns.select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    people = scratch.keep(people, "chat-people")
    seen = turns.join(people, turns["conv_id"].eqNullSafe(people["c"])).drop("c")
    head = head_of(F.col("speaker"), F.col("perspective"))
    body = F.concat("text", F.lit(END))
    seen = seen.select(
        "conv_id", "perspective", "turn", "speaker", "copies", "text",
        F.floor(F.coalesce("turn", F.lit(0)) / CHUNK).alias("chunk"),
        F.length(head).cast("long").alias("head_n"),
        F.length(body).cast("long").alias("body_n"),
    )
    size = F.col("head_n") + F.col("body_n") + len(BREAK)
    sums = seen.groupBy("conv_id", "perspective", "chunk").agg(F.sum(size).alias("n"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    floor = sums.select(
        F.col("conv_id").alias("c"),
        F.col("perspective").alias("p"),
        F.col("chunk").alias("k"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("floor"),
    )
    floor = scratch.keep(floor, "chat-floor")
    within = (
        Window.partitionBy("conv_id", "perspective", "chunk")
        .orderBy(F.asc_nulls_first("turn"), "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = seen.withColumn("before", F.coalesce(F.sum(size).over(within), F.lit(0)))
    placed = placed.join(
        floor,
        placed["conv_id"].eqNullSafe(floor["c"]) & (placed["perspective"] == floor["p"]) & (placed["chunk"] == floor["k"]),
    )
    start = F.col("floor") + F.col("before")
    mine = F.col("speaker") == F.col("perspective")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "copies",
        F.concat(head, body, F.lit(BREAK)).alias("segment"),
        start.alias("start"),
        size.alias("length"),
        (start + F.col("head_n")).alias("mask_start"),
        F.when(mine, F.col("body_n")).otherwise(F.lit(0)).alias("mask_length"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """``(conv_id, perspective, rendered, masks)`` of conversations that fit in a row."""
    parts = segments.groupBy("conv_id", "perspective").agg(
        F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_length"))).alias("s")
    )
    masks = F.transform(
        F.filter("s", lambda x: x["mask_length"] > 0),
        lambda x: F.struct(x["mask_start"].alias("start"), (x["mask_start"] + x["mask_length"]).alias("end")),
    )
    return parts.select(
        "conv_id", "perspective", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("rendered"), masks.alias("masks")
    )
