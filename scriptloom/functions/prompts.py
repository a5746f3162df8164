"""Request texts for a completion service, one template per task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = "\n<context>\n"
_CLOSE = "\n</context>\n"

_SUMMARY_ASK = (
    "Explain this database script to someone who does not write queries: what it does and "
    "what it returns when run. Use plain English and fewer than 100 words. Rate how involved "
    "it is with one label out of Simple, Medium, Complex and Very Complex.\n"
    "Answer with these three labelled parts and nothing else:\n"
    "Summary:\nExpected Output:\nQuery Complexity:"
)

# task -> (text before the script, text after it)
TEMPLATES: dict[str, tuple[str, str]] = {
    "classify": (
        "Say what kind of statement the script below is. Answer with one JSON object and "
        "nothing around it. Its keys: stmt_type (DDL, DML or DCL), object_type (table, view, "
        "function or trigger), operation_type (create or alter), schema_name and object_name. "
        "Use null where the script does not tell.",
        "",
    ),
    "table": (
        "Rewrite this SQL Server table definition for the target warehouse. Leave the schema "
        "out when it is dbo. Write table and column names in upper case, unquoted. Turn every "
        "character type into TEXT, and XML or JSON into VARIANT. Start with CREATE OR REPLACE. "
        "Answer with the statement alone.",
        "",
    ),
    "copy": (
        "Write the load statement for the table defined below. Its rows are in a CSV file that "
        "has the table's name, in the internal stage DATA_STG. Loading continues on errors.",
        "Answer with the load statement alone.",
    ),
    "function": (
        "Rewrite this SQL Server function for the target warehouse. Drop the @ of variable "
        "names, return TEXT for any character type, and declare LANGUAGE SQL. DECLARE blocks "
        "and IF/ELSE branches cannot be used there. Answer with the statement alone.",
        "",
    ),
    "view": (
        "Rewrite this SQL Server view for the target warehouse as CREATE OR REPLACE VIEW. Write "
        "view and column names in upper case, unquoted; put each selected column on its own "
        "line; leave the schema out when it is dbo. Answer with the formatted statement alone.",
        "",
    ),
    "view_summary": (_SUMMARY_ASK, ""),
    "view_dependency": (
        "List the tables and views that the view below reads, joins included, as a numbered "
        "list with one name per line. Add nothing else.",
        "",
    ),
    "trigger": (
        "The target warehouse has no triggers. Turn this SQL Server trigger into a stored "
        "procedure holding its logic, followed by a task that calls it. Leave the schema out "
        "when it is dbo and put each selected column on its own line. Answer with the "
        "formatted statements alone.",
        "",
    ),
    "trigger_summary": (_SUMMARY_ASK, ""),
    "constraint": (
        "This SQL Server script adds referential integrity to a table by ALTER. Rewrite it for "
        "the target warehouse: no dbo schema, names in upper case and unquoted. Answer with the "
        "formatted statement alone.",
        "",
    ),
}


def build_prompt(task: str, body: Column) -> Column:
    """Request text for a task with the script between context tags."""
    head, tail = TEMPLATES[task]
    return F.concat(F.lit(head + _OPEN), body, F.lit(_CLOSE + tail))
