"""Answering every conversation that waits for the assistant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.chat import BUDGET, chat_append, chat_pending, chat_prompt
from scriptloom.operators.complete import BackendFactory, complete


@dataclass(frozen=True)
class Answered:
    history: DataFrame
    refused: DataFrame
    failed: DataFrame


def answer_pending(
    history: DataFrame,
    backend: BackendFactory,
    ledger: str | None = None,
    budget: int = BUDGET,
) -> Answered:
    """The history with a reply to each pending conversation.

    Conversations over the length budget are refused, failed calls are reported; both
    stay pending.
    """
    prompts = chat_prompt(history, budget, only=chat_pending(history))
    asked = prompts.where(~F.col("refused")).select("conv_id", "prompt")
    replies = complete(asked, backend, ledger, spread_by=["conv_id"])
    messages = replies.where(F.col("error").isNull()).select(
        "conv_id", F.lit("assistant").alias("role"), F.col("response").alias("text")
    )
    return Answered(
        history=chat_append(history, messages),
        refused=prompts.where("refused").select("conv_id", "n_units"),
        failed=replies.where(F.col("error").isNotNull()).select("conv_id", "error"),
    )
