"""Rule translation of scripts.

Every translation adds `target_sql`, `target_object_type` and `needs_review`, true when
the script uses something the rules leave alone. One chain of expressions serves a work
list of one kind as well as the whole registry, whose kinds are translated in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import rules
from scriptloom.functions.text import (
    bare_names,
    has_irregular_name,
    normalized,
    tokens,
    without_literals,
)
from scriptloom.operators.once import once
from scriptloom.schema import (
    COMPAT_TARGET_KINDS,
    KEY,
    REGISTRY_COLUMNS,
    TARGET_KINDS,
    WORKLIST_KINDS,
)

# Kinds whose rules keep the case of names.
_KEEP_CASE = ["function", "trigger"]

_TRIGGER_FIELDS = ["trigger_name", "target_table", "timing", "events", "trigger_body"]


def _case(kind: Column, branches: dict[str, Column]) -> Column:
    if len(branches) == 1:
        return next(iter(branches.values()))
    chosen = F.lit(None)
    for name, value in branches.items():
        chosen = F.when(kind == name, value).otherwise(chosen)
    return chosen


def _statements(rows: DataFrame, kinds: list[str], kind: Column) -> DataFrame:
    """Add `__text`, the script's statements, `__code`, the same without literals, upper
    case, and `__irregular`. All three are null for rows without a kind."""
    rows = once(rows, __tokens=F.when(kind.isNotNull(), tokens(F.col("sql_body"))))
    toks = F.col("__tokens")
    if set(kinds) <= set(_KEEP_CASE):
        text = bare_names(toks)
    elif not set(kinds) & set(_KEEP_CASE):
        text = normalized(toks)
    else:
        text = F.when(kind.isin(_KEEP_CASE), bare_names(toks)).otherwise(normalized(toks))
    rows = once(
        rows, __text=rules.statements_only(text), __irregular=has_irregular_name(toks)
    ).drop("__tokens")
    return once(rows, __code=F.upper(without_literals(F.col("__text"))))


def _with_trigger_parts(rows: DataFrame, kind: Column) -> DataFrame:
    parts = rules.trigger_parts(F.col("__text"))
    return once(
        rows, **{name: F.when(kind == "trigger", parts[name]) for name in _TRIGGER_FIELDS}
    )


def _with_view_parts(rows: DataFrame, kind: Column) -> DataFrame:
    rows = once(rows, __ddl=F.when(kind == "view", rules.view_header(F.col("__text"))))
    head, rest = rules.view_parts(F.col("__ddl"))
    rows = once(rows, __head=head, __rest=rest)
    rows = once(rows, __blocks=rules.list_blocks(F.col("__rest")))
    rows = once(rows, __marked=rules.marked_list(F.col("__blocks")))
    return once(rows, __columns=rules.list_columns(F.col("__marked")))


def _target(kind: str) -> tuple[Column, Column]:
    """Target SQL of a kind and what in it asks for review."""
    text, code = F.col("__text"), F.col("__code")
    if kind == "table":
        return rules.table_ddl(text), rules.table_review(code)
    if kind == "constraint":
        return rules.constraint_ddl(text), rules.constraint_review(code)
    if kind == "function":
        return rules.function_ddl(text), rules.function_review(code)
    if kind == "view":
        columns = F.col("__columns")
        ddl = rules.view_ddl(F.col("__ddl"), F.col("__head"), F.col("__marked"), columns)
        return ddl, rules.view_review(code, columns)
    # A trigger's body stays as it is, and its task runs on a schedule.
    fields = [F.col(c) for c in ("trigger_name", "target_table", "events", "trigger_body")]
    return rules.trigger_plan(*fields), F.lit(True)


def _translated(rows: DataFrame, kinds: list[str], kind: Column, compat: bool) -> DataFrame:
    """Add the translation columns to rows that have `sql_body`.

    `kind` is each row's kind out of `kinds`, or null for a row to be left alone.
    """
    rows = _statements(rows, kinds, kind)
    if "trigger" in kinds:
        rows = _with_trigger_parts(rows, kind)
    if "view" in kinds:
        rows = _with_view_parts(rows, kind)
    found = {name: _target(name) for name in kinds}
    names = COMPAT_TARGET_KINDS if compat else TARGET_KINDS
    review = (
        F.col("__irregular")
        | rules.several_statements(F.col("__code"))
        | _case(kind, {name: review for name, (_, review) in found.items()})
    )
    # Filters on the text are common.
    rows = once(rows, new_sql=_case(kind, {name: sql for name, (sql, _) in found.items()}).cast("string"))
    return rows.withColumns(
        {
            "new_type": _case(kind, {name: F.lit(names[name]) for name in kinds}).cast("string"),
            "needs_review": F.coalesce(review, F.lit(True)),
        }
    )


def _from_worklist(work: DataFrame, kind: str, compat: bool, **extra: Column) -> DataFrame:
    return _translated(work, [kind], F.lit(kind), compat).select(
        *KEY,
        F.col("new_sql").alias("target_sql"),
        F.col("new_type").alias("target_object_type"),
        "needs_review",
        *[column.alias(name) for name, column in extra.items()],
    )


def translate_table(work: DataFrame, compat: bool = False) -> DataFrame:
    """Table DDL: no dbo, bare upper-case names, text and variant types, OR REPLACE."""
    return _from_worklist(work, "table", compat)


def translate_constraint(work: DataFrame, compat: bool = False) -> DataFrame:
    """ALTER TABLE: no dbo, bare upper-case names."""
    return _from_worklist(work, "constraint", compat)


def translate_function(work: DataFrame, compat: bool = False) -> DataFrame:
    """Function DDL: no @, text return type, LANGUAGE SQL; flags what is unsupported."""
    code = F.col("__code")
    return _from_worklist(
        work,
        "function",
        compat,
        has_declare=rules.has_declare(code),
        has_branch=rules.has_branch(code),
    )


def translate_view(work: DataFrame, compat: bool = False) -> DataFrame:
    """View DDL: OR REPLACE, bare upper-case names, no dbo, one selected column per line."""
    return _from_worklist(work, "view", compat)


def translate_trigger(work: DataFrame, compat: bool = False) -> DataFrame:
    """Trigger: a procedure with its body, freed of comments, delimiters and dbo, then a task that calls it."""
    fields = {c: F.col(c) for c in ("trigger_name", "target_table", "timing", "events")}
    return _from_worklist(work, "trigger", compat, **fields)


TRANSLATORS: dict[str, Callable[..., DataFrame]] = {
    "table": translate_table,
    "function": translate_function,
    "view": translate_view,
    "trigger": translate_trigger,
    "constraint": translate_constraint,
}


def trigger_headers(work: DataFrame) -> DataFrame:
    """Header fields and body of each trigger."""
    kind = F.lit("trigger")
    rows = _with_trigger_parts(_statements(work, ["trigger"], kind), kind)
    return rows.select(*KEY, *_TRIGGER_FIELDS)


def copy_statements(tables: DataFrame) -> DataFrame:
    """Load statement for each translated table; null where no table name is found."""
    named = once(tables, __name=rules.table_name(F.col("target_sql")))
    return named.select(*KEY, rules.copy_statement(F.col("__name")).alias("copy_sql"))


def translate_registry(
    registry: DataFrame,
    kinds: list[str] | None = None,
    compat: bool = False,
    batch_ts: datetime | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """The registry with every script of the given kinds translated where it is.

    A rule translation depends on nothing but its own row, so unlike
    `apply_translation` this needs no join and no shuffle. Rows that have a translation
    keep it unless `overwrite` is set. A script the rules cannot read keeps what it has and
    is marked for review; it gets no time, as nothing was translated.
    """
    kinds = kinds or list(WORKLIST_KINDS)
    kind = F.lit(None).cast("string")
    for name in kinds:
        object_type, operation_type = WORKLIST_KINDS[name]
        is_kind = (
            (F.col("stmt_type") == "DDL")
            & (F.col("object_type") == object_type)
            & (F.col("operation_type") == operation_type)
        )
        kind = F.when(is_kind, name).otherwise(kind)
    if not overwrite:
        kind = F.when(F.col("target_sql").isNull(), kind)
    marked = registry.withColumnRenamed("needs_review", "__review")
    rows = _translated(once(marked, __kind=kind), kinds, F.col("__kind"), compat)
    stamp = F.current_timestamp() if batch_ts is None else F.lit(batch_ts)
    changed = {
        "target_sql": F.col("new_sql"),
        "target_object_type": F.col("new_type"),
        "updated_ts": stamp,
    }
    is_read = F.col("__kind").isNotNull()
    is_changed = is_read & F.col("new_sql").isNotNull()
    review = F.when(is_read, F.col("needs_review")).otherwise(F.col("__review"))
    return rows.withColumn("needs_review", review).select(
        *[
            F.when(is_changed, changed[c]).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in REGISTRY_COLUMNS
        ]
    )
