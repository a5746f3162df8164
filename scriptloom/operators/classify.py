"""Classification of scripts and the reading of classification replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.replies import (
    classification_fault,
    json_object,
    json_readings,
    json_value,
)
from scriptloom.functions.rules import classify_header, statement_header
from scriptloom.operators.once import once
from scriptloom.schema import CLASS_KEYS


def classify_scripts(scripts: DataFrame) -> DataFrame:
    """Add `response`: the classification of `sql_body` by rules, as a JSON object.

    Keys with a null value are written out, as the reply parser demands all five.
    """
    headed = once(scripts, __header=statement_header(F.col("sql_body")))
    values = classify_header(F.col("__header"))
    answer = F.struct(*[values[k].alias(k) for k in CLASS_KEYS])
    return headed.withColumn("response", F.to_json(answer, {"ignoreNullFields": "false"})).drop(
        "__header"
    )


def parse_classification(replies: DataFrame) -> DataFrame:
    """Add the five classification columns and `fault`, null for a usable reply.

    A usable reply is exactly one JSON object that has all five keys; null values
    pass and further keys are ignored. A frame with an `error` column (from a
    completion service) reports that error as the fault.
    """
    read = once(replies, **json_readings(F.col("response")))
    parsed = once(read, __fields=json_object(F.col("__elements"), F.col("__whole")))
    fault = classification_fault(F.col("response"), F.col("__fields"))
    if "error" in replies.columns:
        fault = F.coalesce(F.concat(F.lit("service: "), F.col("error")), fault)
    parsed = once(parsed, fault=fault)
    values = {
        key: F.when(F.col("fault").isNull(), json_value(F.col("__fields"), key))
        for key in CLASS_KEYS
    }
    return once(parsed, **values).drop("__elements", "__whole", "__fields")


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fault").isNull()).drop("fault")


def classification_rejects(parsed: DataFrame) -> DataFrame:
    """Rows that cannot be registered, with the reason."""
    return parsed.where(F.col("fault").isNotNull()).select(
        "sql_file_name", "path", "md5", F.col("fault").alias("reason"), "response"
    )
