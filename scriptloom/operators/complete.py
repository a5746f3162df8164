"""Batched calls of a completion service, one per distinct prompt, kept in a ledger."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.operators.skew import HOT_KEYS, HOT_ROWS, key_hash, salted_left_join
from scriptloom.session import work_dir
from scriptloom.sources.registry import path_exists

# A backend answers a list of prompts in order. The factory runs once per Python
# worker task, so a client or model is opened there and not shipped.
Backend = Callable[[Sequence[str]], Sequence[str]]
BackendFactory = Callable[[], Backend]

LEDGER_SCHEMA = "model string, prompt_hash string, response string, error string"


# Calls one task makes: what a lost executor costs at most.
CALLS_PER_TASK = 10_000
# What a call costs besides its prompt, in characters.
CALL_COST = 200


def read_ledger(
    spark: SparkSession, path: str, wanted: DataFrame | None = None, model: str | None = None
) -> DataFrame:
    """One row per prompt: its answer, or the error when no attempt succeeded.

    Answers belong to the model that gave them; without one they are those of backends that
    were not named. `wanted` restricts the rows to the prompts of one run; a small run then
    joins a ledger grown over many by broadcast and aggregates its own entries only.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "prompt_hash string, response string, error string")
    entries = _entries(spark, path, model)
    if wanted is not None:
        entries = entries.join(wanted.select("prompt_hash"), "prompt_hash", "left_semi")
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response", "error"))
    return (
        entries.groupBy("prompt_hash")
        .agg(best.alias("best"))
        .select("prompt_hash", "best.response", "best.error")
    )


def _entries(spark: SparkSession, path: str, model: str | None) -> DataFrame:
    entries = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return entries.where(F.col("model").eqNullSafe(F.lit(model).cast("string")))


def _caller(
    factory: BackendFactory,
    batch_size: int,
    model: str | None = None,
    in_flight: int = 1,
    attempts: int = 1,
    backoff: float = 1.0,
):
    """A task's calls: a bounded number at a time, repeated after growing pauses.

    Replies go on as they come; the prompt's hash goes with them, so order does not matter.
    """

    def ask(backend: Backend, prompts: list[str]) -> list[str]:
        replies = list(backend(prompts))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        return replies

    def answer(backend: Backend, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(reply, None) for reply in ask(backend, prompts)]
        except Exception as error:
            if len(prompts) > 1:
                # One bad prompt must not fail its batch.
                return [answer(backend, [prompt])[0] for prompt in prompts]
            failed = error
        for attempt in range(1, attempts):
            time.sleep(backoff * 2 ** (attempt - 1))
            try:
                return [(ask(backend, prompts)[0], None)]
            except Exception as error:
                failed = error
        return [(None, f"{type(failed).__name__}: {failed}")]

    def replies(hashes: list[str], answers: list[tuple[str | None, str | None]]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "model": pd.Series([model] * len(hashes), dtype="object"),
                "prompt_hash": pd.Series(hashes, dtype="object"),
                "response": pd.Series([a[0] for a in answers], dtype="object"),
                "error": pd.Series([a[1] for a in answers], dtype="object"),
            }
        )

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        calls: dict[Future, list[str]] = {}

        def ended(until: str) -> Iterator[pd.DataFrame]:
            done, _ = wait(calls, return_when=until)
            for future in done:
                yield replies(calls.pop(future), future.result())

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                prompts, hashes = frame["prompt"].tolist(), frame["prompt_hash"].tolist()
                for start in range(0, len(prompts), batch_size):
                    while len(calls) >= in_flight:
                        yield from ended(FIRST_COMPLETED)
                    end = start + batch_size
                    calls[pool.submit(answer, backend, prompts[start:end])] = hashes[start:end]
            while calls:
                yield from ended(FIRST_COMPLETED)

    return call


def equal_shares(prompts: DataFrame, tasks: int, call_cost: int = CALL_COST) -> DataFrame:
    """The prompts dealt to tasks of about equal cost, that of a call being its length and
    a constant. Their lengths are added up in the order of their hashes, over ranges and then
    within them, and the sum is cut into equal shares."""
    cost = (F.length("prompt") + call_cost).alias("cost")
    lengths = prompts.select("prompt_hash", cost).repartitionByRange("prompt_hash")
    stored = work_dir(prompts.sparkSession, "costs")
    lengths.withColumn("part", F.spark_partition_id()).write.parquet(stored)
    lengths = prompts.sparkSession.read.parquet(stored)
    parts = lengths.groupBy("part").agg(F.sum("cost").alias("total"))
    total = parts.agg(F.sum("total").alias("t")).first()["t"] or 1
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("part").orderBy("prompt_hash").rowsBetween(Window.unboundedPreceding, 0)
    summed = lengths.withColumn("upto", F.sum("cost").over(upto)).join(bases, "part")
    # The middle of a prompt decides, so a long one does not push its neighbours aside.
    middle = F.col("base") + F.col("upto") - F.col("cost") / 2
    share = F.least(F.floor(middle * tasks / total), F.lit(tasks - 1)).cast("int")
    shares = summed.select("prompt_hash", share.alias("share"))
    return prompts.join(shares, "prompt_hash").repartitionById(tasks, F.col("share")).drop("share")


def complete(
    rows: DataFrame,
    factory: BackendFactory,
    ledger: str | None = None,
    prompt: str = "prompt",
    parallelism: int | None = None,
    batch_size: int = 32,
    spread_by: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    model: str | None = None,
    in_flight: int = 1,
    attempts: int = 1,
    backoff: float = 1.0,
) -> DataFrame:
    """Add `response` and `error` for the prompt of each row.

    `model` names what answers: the ledger keeps the answers of each model apart. Tasks get
    shares of about equal length in all. Each has up to `in_flight` calls under way, from
    threads if it is more than one, and makes up to `attempts` of a prompt that fails, the
    pause before the next starting at `backoff` seconds and doubling.

    Distinct prompts are written out first, so neither the scan nor the rules behind
    them run again while the service is slow or a task is retried. Prompts with an
    answer in the ledger are not asked again; failed ones are. New answers are in
    the ledger before they are joined back.
    """
    spark = rows.sparkSession
    ledger = ledger or work_dir(spark, "ledger")
    spread_by = spread_by or [c for c in rows.columns if c != prompt]
    # Rows without a prompt match no answer; a hash of their own keeps them apart.
    own = F.concat(F.lit("none "), F.xxhash64(*(spread_by or [prompt])).cast("string"))
    keyed = rows.withColumn("prompt_hash", F.coalesce(F.sha2(prompt, 256), own))

    asked = work_dir(spark, "prompts")
    (
        keyed.where(F.col(prompt).isNotNull())
        .groupBy("prompt_hash")
        .agg(F.first(prompt).alias("prompt"), F.count(F.lit(1)).alias("n_rows"))
        .write.parquet(asked)
    )
    prompts = spark.read.parquet(asked)

    waiting = prompts.select("prompt_hash", "prompt")
    if path_exists(spark, ledger):
        # An anti-join needs no distinct keys: the ledger's replies are neither read nor moved.
        answered = _entries(spark, ledger, model).where("error is null").select("prompt_hash")
        waiting = waiting.join(answered, "prompt_hash", "left_anti")
    # Prompts are small and calls slow: tasks are sized by calls, not by bytes.
    slots = spark.sparkContext.defaultParallelism
    tasks = parallelism or max(slots, waiting.count() // CALLS_PER_TASK)
    (
        equal_shares(waiting, tasks)
        .mapInPandas(_caller(factory, batch_size, model, in_flight, attempts, backoff), LEDGER_SCHEMA)
        .write.mode("append")
        .parquet(ledger)
    )

    hot = _hot_prompts(prompts, hot_rows)
    answers = read_ledger(spark, ledger, prompts, model)
    spread_by = spread_by or ["prompt_hash"]
    return salted_left_join(keyed, answers, ["prompt_hash"], hot, spread_by).drop("prompt_hash")


def _hot_prompts(prompts: DataFrame, hot_rows: int) -> list[int]:
    top = (
        prompts.where(F.col("n_rows") >= hot_rows)
        .orderBy(F.col("n_rows").desc())
        .limit(HOT_KEYS)
        .select(key_hash(["prompt_hash"]).alias("h"))
    )
    return [r.h for r in top.collect()]
