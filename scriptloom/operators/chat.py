"""Multi-turn conversations: history table (conv_id, turn, role, text) in, prompts out.

One conversation may be any share of the history. Only conversations below the length
budget are ever gathered; lengths and last turns come from partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import word_count
from scriptloom.operators.skew import hot_key_hashes, key_hash

# The message tags of the prompt format and its length budget.
START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 3072

# Conversations over budget of so many messages are filtered out before the shuffle, at
# most HOT_KEYS of them, found with a frequent-items sketch.
_MANY_TURNS = 10_000

GREETING = "Hello, I can help with moving your database scripts. What would you like to know?"


def message_piece(role: Column, text: Column) -> Column:
    """One message between its tags; any role but user speaks as the assistant, a null text
    says nothing."""
    speaker = F.when(role == "user", "user").otherwise("assistant")
    return F.concat(F.lit(START), speaker, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def chat_lengths(
    history: DataFrame, count_units: Callable[[Column], Column] = word_count
) -> DataFrame:
    """Messages and prompt length of each conversation; rows without an id belong to none.

    The prompt is its pieces on separate lines, so the lengths of the pieces add up;
    `count_units` must have that property. The closing assistant tag adds its own.
    """
    units = count_units(message_piece(F.col("role"), F.col("text")))
    return history.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        (F.sum(units) + count_units(F.lit(START + "assistant\n"))).alias("n_units"),
    )


def chat_budget(
    history: DataFrame,
    budget: int = BUDGET,
    count_units: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Length of each conversation's prompt and whether it is refused as too long."""
    return chat_lengths(history, count_units).select(
        "conv_id", "n_turns", "n_units", (F.col("n_units") >= budget).alias("refused")
    )


def chat_prompt(
    history: DataFrame,
    budget: int = BUDGET,
    count_units: Callable[[Column], Column] = word_count,
    only: DataFrame | None = None,
) -> DataFrame:
    """Prompt of each conversation; null for one that is refused as too long.

    `only` restricts the result to the conversations whose ids it holds.

    Refused conversations are not gathered. Those of very many messages are filtered out
    before the shuffle through a list of fixed size, so that no conversation holding a
    large share of the history reaches a single task; the rest drop out in the join.
    A message adds to the length, so one of more messages than the budget is refused.
    """
    lengths = chat_budget(history, budget, count_units)
    kept = history
    hot = hot_key_hashes(history, ["conv_id"], max(_MANY_TURNS, budget + 1)) if count_units is word_count else []
    if hot:
        # A hash shared by two conversations must not lose the one that is not refused.
        long = lengths.where(F.col("refused") & key_hash(["conv_id"]).isin(hot)).select("conv_id")
        kept = history.join(long, "conv_id", "left_anti")
    # Naming the turn count keeps all three uses of the lengths the same aggregate, whose
    # shuffle output Spark then computes once and reuses.
    wanted = lengths.where(F.col("n_turns") > 0)
    if only is not None:
        wanted = wanted.join(only.select("conv_id").distinct(), "conv_id", "left_semi")
    accepted = wanted.where(~F.col("refused")).select("conv_id")
    piece = message_piece(F.col("role"), F.col("text")).alias("piece")
    pieces = F.array_sort(F.collect_list(F.struct("turn", piece)))
    prompts = (
        kept.join(accepted, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(pieces.alias("pieces"))
        .select(
            "conv_id",
            F.concat(
                F.array_join(F.col("pieces.piece"), "\n"), F.lit(f"\n{START}assistant\n")
            ).alias("prompt"),
        )
    )
    return wanted.join(prompts, "conv_id", "left")


def chat_pending(history: DataFrame) -> DataFrame:
    """Conversations whose last message is not the assistant's."""
    last = history.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"),
        F.max_by(~F.col("role").eqNullSafe("assistant"), "turn").alias("open"),
    )
    return last.where("open").select("conv_id", "last_turn")


def chat_append(history: DataFrame, messages: DataFrame) -> DataFrame:
    """The history with one message (conv_id, role, text) added per conversation."""
    return history.unionByName(next_turns(history, messages))


def next_turns(history: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages numbered to follow the last turn of their conversation."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    turn = F.coalesce(F.col("last_turn") + 1, F.lit(0)).cast("bigint").alias("turn")
    return messages.join(last, "conv_id", "left").select("conv_id", turn, "role", "text")


def chat_seed(history: DataFrame, conversations: DataFrame) -> DataFrame:
    """A greeting as first message for each conversation that has no history."""
    started = history.select("conv_id").distinct()
    return (
        conversations.select("conv_id")
        .distinct()
        .join(started, "conv_id", "left_anti")
        .select(
            "conv_id",
            F.lit(0).cast("bigint").alias("turn"),
            F.lit("assistant").alias("role"),
            F.lit(GREETING).alias("text"),
        )
    )
