"""The tasks a completion service is asked for, answered by it or by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import rules
from scriptloom.functions.prompts import TEMPLATES, build_prompt
from scriptloom.functions.text import code_only, tokens
from scriptloom.operators.classify import classify_scripts
from scriptloom.operators.complete import BackendFactory, complete
from scriptloom.operators.once import once
from scriptloom.operators.translate import TRANSLATORS
from scriptloom.schema import KEY

# Tasks that only a service can answer: free text about a script.
SERVICE_ONLY = ["view_summary", "trigger_summary"]


def answer_task(
    scripts: DataFrame,
    task: str,
    backend: BackendFactory | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Key, `response` and `error` for each script (key columns and `sql_body`).

    Without a backend the rules answer, each row where it is: they cost less than the
    shuffle that would find repeated prompts. The load statement task takes translated
    table DDL as its script.
    """
    if task not in TEMPLATES:
        raise ValueError(f"unknown task: {task}")
    if backend is not None:
        asked = scripts.select(*KEY, build_prompt(task, F.col("sql_body")).alias("prompt"))
        return complete(asked, backend, ledger, spread_by=KEY).drop("prompt")
    if task in SERVICE_ONLY:
        raise ValueError(f"{task} needs a completion backend")
    return _by_rules(scripts, task).select(
        *KEY, "response", F.lit(None).cast("string").alias("error")
    )


def _by_rules(scripts: DataFrame, task: str) -> DataFrame:
    if task == "classify":
        return classify_scripts(scripts)
    if task in TRANSLATORS:
        return TRANSLATORS[task](scripts).withColumnRenamed("target_sql", "response")
    if task == "copy":
        named = once(scripts, __name=rules.table_name(F.col("sql_body")))
        return named.withColumn("response", rules.copy_statement(F.col("__name")))
    code = once(scripts, __code=code_only(tokens(F.col("sql_body"))))
    lines = F.transform(
        rules.source_names(F.col("__code")),
        lambda name, i: F.concat((i + 1).cast("string"), F.lit(". "), name),
    )
    return code.withColumn("response", F.array_join(lines, "\n"))
