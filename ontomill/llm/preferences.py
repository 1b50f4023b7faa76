"""Preference formatting of chat conversations.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns
(same role and same text, from the first turn on) is rendered once as the prompt; what
follows is rendered as two completions. In a completion only what an assistant says is
trained on: its mask is a list of character spans.

A conversation is a list of turns in order; it is one training text, so it is gathered
in one row. Turns are put in order of (turn, role, text), nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written: open mark, role, line end, text, close mark.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def conversations_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>)``; null roles and texts are empty.

    Rows with a null conv_id belong to no conversation and are left out. Repeated rows
    are turns that occur twice. Other columns are ignored.
    """
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    listed = (
        turns.filter(F.col("conv_id").isNotNull())
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(row)).alias("turns"))
    )
    return listed.withColumn(
        "turns",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))),
    )


def _written(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _written), "")


def mask(turns: Column) -> Column:
    """Spans ``(begin, end)`` of the characters to train on, the close mark included."""
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<begin:int,end:int>>").alias("spans"))

    def onward(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(OPEN) + F.length(turn["role"]) + len(MIDDLE)
        end = state["at"] + F.length(_written(turn))
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    return F.aggregate(turns, start, onward)["spans"]


def common_turns(one: Column, other: Column) -> Column:
    """Turns at the start that are the same in both."""
    n = F.least(F.size(one), F.size(other))
    differ = F.filter(
        F.sequence(F.lit(1), n), lambda i: ~F.element_at(one, i).eqNullSafe(F.element_at(other, i))
    )
    return F.when(n < 1, F.lit(0)).otherwise(
        F.coalesce(F.get(differ, F.lit(0)) - 1, n)
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Prompt, completions and masks of every pair.

    ``pairs`` has ``pair_id`` and ``chosen`` and ``rejected`` as arrays of
    ``struct<role, text>``. A null conversation is one without turns; equal
    conversations have empty completions. Row by row, no shuffle.
    """
    none = F.expr("array()").cast("array<struct<role:string,text:string>>")
    whole = pairs.select(
        "pair_id",
        F.coalesce("chosen", none).alias("_c"),
        F.coalesce("rejected", none).alias("_r"),
    ).withColumn("n_prompt_turns", F.when((F.size("_c") == 0) | (F.size("_r") == 0), 0).otherwise(common_turns(F.col("_c"), F.col("_r"))))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n_prompt_turns") + 1, F.size(name))

    cut = whole.select(
        "pair_id",
        "n_prompt_turns",
        F.slice("_c", F.lit(1), F.col("n_prompt_turns")).alias("_p"),
        rest("_c").alias("_c"),
        rest("_r").alias("_r"),
    )
    return cut.select(
        "pair_id",
        "n_prompt_turns",
        render(F.col("_p")).alias("prompt"),
        render(F.col("_c")).alias("chosen"),
        render(F.col("_r")).alias("rejected"),
        mask(F.col("_c")).alias("chosen_mask"),
        mask(F.col("_r")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k and 2k + 1: the first is chosen, the other rejected.

    A conversation without its partner is paired with an empty one.
    """
    listed = conversations_of(turns).withColumn("_even", F.pmod("conv_id", F.lit(2)) == 0)
    return listed.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(
        F.max(F.when(F.col("_even"), F.col("turns"))).alias("chosen"),
        F.max(F.when(~F.col("_even"), F.col("turns"))).alias("rejected"),
    )
