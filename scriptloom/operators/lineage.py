"""What views read, how involved scripts are, and replies that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import rules
from scriptloom.functions.replies import dependency_lines, summary_checks, summary_parts
from scriptloom.functions.text import code_only, tokens
from scriptloom.operators.once import once
from scriptloom.schema import KEY


_NAMED = [*KEY, "schema_name", "object_name"]


def with_sources(views: DataFrame) -> DataFrame:
    """Key and upper-case name of each view script, and `sources`, the names it reads."""
    code = once(views, __code=code_only(tokens(F.col("sql_body"))))
    upper = [F.upper(c).alias(c) for c in ("schema_name", "object_name")]
    return once(code.select(*KEY, *upper, "__code"), sources=rules.source_names(F.col("__code")))


def view_dependencies(views: DataFrame) -> DataFrame:
    """Edges from a view to each table or view it reads, once per script.

    A view is its script: two of one name in different schemas, or two versions of a file,
    keep their own edges. Sources are distinct in their row, so nothing is shuffled.
    """
    return with_sources(views).select(*_NAMED, F.explode("sources").alias("depends_on"))


def view_dependency_counts(views: DataFrame) -> DataFrame:
    """Number of tables and views each view script reads; one that reads none counts 0."""
    return with_sources(views).select(
        *_NAMED, F.size("sources").cast("bigint").alias("n_dependencies")
    )


def script_complexity(scripts: DataFrame) -> DataFrame:
    """Joins, sub-selects and groupings of each script, and a complexity label."""
    code = once(scripts, __code=code_only(tokens(F.col("sql_body"))))
    counted = once(code, **rules.complexity_points(F.col("__code")))
    points = ["n_joins", "n_subselects", "n_groupings"]
    total = F.col("n_joins") + F.col("n_subselects") + F.col("n_groupings")
    label = rules.complexity_label(total).alias("complexity")
    return counted.select("sql_file_name", "_stg_sql_file_md5", *points, label)


def parse_dependency_reply(replies: DataFrame) -> DataFrame:
    """One row per entry of each reply's numbered list."""
    entries = F.posexplode(dependency_lines(F.col("response"))).alias("pos", "depends_on")
    return replies.select(
        "sql_file_name", "_stg_sql_file_md5", entries
    ).select(
        "sql_file_name",
        "_stg_sql_file_md5",
        (F.col("pos") + 1).cast("bigint").alias("position"),
        "depends_on",
    )


def parse_summary_reply(replies: DataFrame) -> DataFrame:
    """The three parts of each summary reply and whether it kept to the request."""
    parts = once(replies, **summary_parts(F.col("response")))
    checks = summary_checks(F.col("summary"), F.col("expected_output"), F.col("label"))
    return once(parts, **checks).select(
        "sql_file_name",
        "_stg_sql_file_md5",
        "summary",
        "expected_output",
        *checks,
    )
