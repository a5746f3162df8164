"""The SQL each registered query must agree with, for DuckDB on the same tables."""

from __future__ import annotations

from checks.corpus import corpus_sql
from checks.exported import exported_sql
from checks.nested import nested_sql
from checks.queries import (
    COLUMN_TEXT,
    DEPENDENCY_REPLY,
    SMALL_BUDGET,
    SQL_TEXT,
    SUMMARY_REPLY,
)
from scriptloom.functions.prompts import TEMPLATES
from scriptloom.functions.text import TITLE_DELIMITERS
from scriptloom.operators.chat import BUDGET, GREETING
from scriptloom.schema import WORKLIST_KINDS, WORKLIST_LIMITS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _ctes(*named: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in named) + "\n"


# --- the corpus, classified and registered ------------------------------------------

_TOKEN = (
    r"(?s)''[^'']*''?|--[^\n]*|/\*.*?(?:\*/|\z)|\[[^\]]*\]|\"[^\"]*\"|[^''\"\[/-]+|."
).replace(r"\"", '"')


def _render(body: str, code: str, literal: str) -> str:
    """Comments to a space, delimiters off; `code` and `literal` are over token t."""
    name = "regexp_replace(t[2:length(t) - 1], '[^\\w]', '_', 'g')"
    name = name if code == "t" else f"upper({name})"
    return (
        f"array_to_string(list_transform(regexp_extract_all({body}, '{_TOKEN}'), lambda t: "
        f"case when starts_with(t, '''') then {literal} "
        "when starts_with(t, '--') or starts_with(t, '/*') then ' ' "
        f"when length(t) > 1 and t[1] in ('[', '\"') then {name} else {code} end), '')"
    )


def _outside_literals(text: str, rule: str) -> str:
    """`rule` is an expression over s, applied to the code segments of `text`."""
    return (
        f"array_to_string(list_transform(string_split({text}, ''''), "
        f"lambda s, i: case when i % 2 = 1 then {rule} else s end), '''')"
    )


def _sub(expr: str, *pairs: tuple[str, str]) -> str:
    for pattern, new in pairs:
        expr = f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"
    return expr


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
def _statements(text: str) -> str:
    """Without the preamble of the annotated corpus: lines that hold USE, SET or GO."""
    return f"regexp_replace({text}, '(?m)^(?:(?i:USE \\w+|SET ANSI_NULLS ON|GO)\n)+', '')"


BARE = _render("sql_body", "t", "t")
NORMAL = _statements(_render("sql_body", "upper(t)", "t"))
BARE_STATEMENTS = _statements(BARE)
CODE = _render("sql_body", "upper(t)", "''''''")


def _classified(variant: str) -> list[tuple[str, str]]:
    scanned = f"""
select k, string_split(path, '/')[-1] as sql_file_name, path, load_ts, md5, sql_body
from ({corpus_sql(variant)})
where regexp_full_match(path, '.*MS-SQL-Server-Script.*[.]sql')"""
    # Code without its comments and preamble starts with the statement itself.
    code = _sub(BARE, (r"(?m)^[ \t]*(?:USE [^\n]*|SET [^\n]*|GO)[ \t]*$", ""))
    split = rf"""
select *, upper(regexp_extract(code, '^\s*(\w+)', 1)) as verb,
       upper(regexp_extract(code, '^\s*\w+\s+(\w+)', 1)) as word2,
       string_split(regexp_extract(code,
         case when regexp_matches(code, '^\s*GRANT') then '\bON\s+([\w.]+)'
              else '^\s*\w+\s+\w+\s+([\w.]+)' end, 1), '.') as parts
from (select *, {code} as code from scanned)"""
    named = """
select k, sql_file_name, path, load_ts, md5, sql_body,
       case when verb in ('CREATE', 'ALTER') then 'DDL'
            when verb = 'INSERT' then 'DML' when verb = 'GRANT' then 'DCL' end as stmt_type,
       case when verb in ('CREATE', 'ALTER') then lower(word2) end as object_type,
       case when verb in ('CREATE', 'ALTER') then lower(verb) end as operation_type,
       case when len(parts) > 1 then parts[-2] end as schema_name,
       parts[-1] as object_name
from split"""
    classified = """
select *, json_object('stmt_type', stmt_type, 'object_type', object_type,
                      'operation_type', operation_type, 'schema_name', schema_name,
                      'object_name', object_name)::varchar as response
from named"""
    return [("scanned", scanned), ("split", split), ("named", named), ("classified", classified)]


def _registered(variant: str) -> list[tuple[str, str]]:
    registry = """
select sql_file_name, sql_body, path as _stg_sql_file_name, load_ts as _stg_sql_file_load_ts,
       md5 as _stg_sql_file_md5, response as completion_response,
       stmt_type, object_type, operation_type, schema_name, object_name
from classified
qualify row_number() over (partition by sql_file_name, md5 order by path) = 1"""
    return [*_classified(variant), ("registry", registry)]


_REPLIES = [
    *_classified("plain"),
    (
        "replies",
        """
select k, sql_file_name, path, load_ts, md5, sql_body,
       case k % 11 when 1 then response || ' as asked'
                   when 2 then regexp_replace(response, ',"object_name":[^}]*', '')
                   when 3 then response || '}' else response end as response
from classified""",
    ),
    (
        "parsed",
        """
select *,
       case when not json_valid(response) then 'not a JSON object'
            when not list_contains(json_keys(response), 'object_name')
              then 'missing key: object_name' end as fault,
       """
        + ",\n       ".join(
            f"case when json_valid(response) and fault is null "
            f"then json_extract_string(response, '$.{key}') end as {key}"
            for key in (
                "stmt_type",
                "object_type",
                "operation_type",
                "schema_name",
                "object_name",
            )
        )
        + "\nfrom replies",
    ),
]
_GOOD = [*_REPLIES, ("good", "select * from parsed where fault is null")]

_SCAN = f"""
select path, load_ts, md5, sql_body from ({corpus_sql("plain")})
where regexp_full_match(path, '.*MS-SQL-Server-Script.*[.]sql')"""


_FILES = f"""
select distinct path, sql_body, true as has_load_ts,
       md5(case when length(sql_body) % 3 = 0 then '\\xEF\\xBB\\xBF'::blob || encode(sql_body)
                else encode(sql_body) end) as md5
from ({corpus_sql("plain")})
where regexp_full_match(path, '.*MS-SQL-Server-Script.*[.]sql')"""


# Half of the files first, then the other half, then none.
_ONBOARDED = """
select string_split(f.path, '/')[-1] as sql_file_name, f.md5 as _stg_sql_file_md5, min(f.path) as path,
       any_value(stmt_type) as stmt_type, any_value(object_type) as object_type,
       any_value(operation_type) as operation_type, any_value(schema_name) as schema_name,
       any_value(object_name) as object_name,
       (select count(*) from files where path like 'stage/a/%') as opened_1,
       (select count(*) from files where path like 'stage/b/%') as opened_2, 0::bigint as opened_3
from files f join registry r on r.sql_file_name = string_split(f.path, '/')[-1]
group by 1, 2
"""

# --- translation --------------------------------------------------------------------

_ARGS = r"(?:\s*\(\s*[\w\s,.]*\))?"
_TEXT = (
    r"(?:(?:NATIONAL\s+)?(?:N?VARCHAR|N?CHAR|CHARACTER)(?:\s+VARYING)?\b"
    + _ARGS
    + r"|(?:N?TEXT|STRING|SYSNAME)\b"
    + _ARGS
    + ")"
)
_DBO = (r"(?i)\bDBO\s*\.\s*", "")

_TABLE = _outside_literals(
    NORMAL,
    _sub(
        "s",
        _DBO,
        (rf"([\w$#]\s+){_TEXT}", r"\1TEXT"),
        (rf"([\w$#]\s+)(?:XML|JSON)\b{_ARGS}", r"\1VARIANT"),
        (r"\bCREATE\s+TABLE\b", "CREATE OR REPLACE TABLE"),
    ),
)
_CONSTRAINT = _outside_literals(NORMAL, _sub("s", _DBO))
_FUNCTION = _outside_literals(
    BARE_STATEMENTS,
    _sub(
        "s",
        (r"@+([A-Za-z_#])", r"\1"),
        (rf"(?i)\bRETURNS(\s+){_TEXT}", r"RETURNS\1TEXT"),
        (r"(?i)\b(RETURNS\s+TEXT)(\s+AS\b)", r"\1 LANGUAGE SQL\2"),
    ),
)
_VIEW = _outside_literals(
    NORMAL, _sub("s", _DBO, (r"\bCREATE\s+VIEW\b", "CREATE OR REPLACE VIEW"))
)
# The views of the corpus select two plain columns from one FROM clause.
_VIEW_LINES = (
    rf"regexp_replace(trim({_VIEW}, {_BLANKS}), '(?s)\bSELECT\s+([^,]*?)\s*,\s*([^,]*?)\s+FROM\b', "
    rf"'SELECT' || chr(10) || '    \1,' || chr(10) || '    \2' || chr(10) || 'FROM')"
)


def _trigger(group: int) -> str:
    pattern = r"(?is)CREATE\s+TRIGGER\s+(\S+)\s+ON\s+(\S+)\s+(AFTER)\s+(INSERT)\s+AS\s+(.*)$"
    return f"regexp_extract(bare, '{pattern}', {group})"


_TRIGGERS = (
    "triggers",
    f"""
select sql_file_name, _stg_sql_file_md5,
       {_sub(f"upper({_trigger(1)})", _DBO)} as trigger_name,
       {_sub(f"upper({_trigger(2)})", _DBO)} as target_table,
       upper({_trigger(3)}) as timing, upper({_trigger(4)}) as events,
       trim({_trigger(5)}, {_BLANKS}) as trigger_body
from (select *, {BARE_STATEMENTS} as bare from registry
      where object_type = 'trigger' and operation_type = 'create')""",
)
_TRIGGER_PLAN = """
'CREATE OR REPLACE PROCEDURE ' || trigger_name || '_PROC()' || chr(10) || 'RETURNS TEXT' || chr(10)
 || 'LANGUAGE SQL' || chr(10) || 'AS' || chr(10) || '$$' || chr(10) || 'BEGIN' || chr(10) || '    '
 || trigger_body || chr(10) || 'END' || chr(10) || '$$;' || chr(10) || chr(10)
 || '-- Replaces the trigger on ' || target_table || ' for ' || events || chr(10)
 || 'CREATE OR REPLACE TASK ' || trigger_name || '_TASK' || chr(10)
 || '    SCHEDULE = ''1 MINUTE''' || chr(10) || 'AS' || chr(10)
 || '    CALL ' || trigger_name || '_PROC();'"""

_TARGETS = {"table": _TABLE, "constraint": _CONSTRAINT, "function": _FUNCTION, "view": _VIEW_LINES}
_KINDS = {
    "table": "'Table'",
    "constraint": "null::varchar",
    "function": "'Function'",
    "view": "'View'",
    "trigger": "'Task'",
}


def _work(kind: str) -> str:
    object_type, operation_type = WORKLIST_KINDS[kind]
    return (
        f"stmt_type = 'DDL' and object_type = '{object_type}' "
        f"and operation_type = '{operation_type}'"
    )


def _review(kind: str) -> str:
    """In the corpus only a DECLARE or a name that needs its delimiters."""
    review = r"regexp_matches(sql_body, '\[[^\]]*-[^\]]*\]')"
    return review + (r" or regexp_matches(code, '\bDECLARE\b')" if kind == "function" else "")


def _translated(kind: str, variant: str) -> tuple[str, str]:
    if kind == "trigger":
        return (
            "translated",
            f"""
select sql_file_name, _stg_sql_file_md5, {_TRIGGER_PLAN} as target_sql,
       'Task' as target_object_type, true as needs_review,
       trigger_name, target_table, timing, events
from triggers""",
        )
    review = _review(kind)
    extra = ""
    if kind == "function":
        extra = r", regexp_matches(code, '\bDECLARE\b') as has_declare, false as has_branch"
    return (
        "translated",
        f"""
select sql_file_name, _stg_sql_file_md5, trim({_TARGETS[kind]}, {_BLANKS}) as target_sql,
       {_KINDS[kind]} as target_object_type, {review} as needs_review{extra}
from (select *, {CODE} as code from registry where {_work(kind)})""",
    )


def _translate_sql(kind: str, variant: str) -> str:
    before = [_TRIGGERS] if kind == "trigger" else []
    return (
        _ctes(*_registered(variant), *before, _translated(kind, variant))
        + "select * from translated"
    )


def _all_targets_sql() -> str:
    targets = [
        f"select sql_file_name, _stg_sql_file_md5, trim({target}, {_BLANKS}) as new_sql, "
        f"{_KINDS[kind]} as new_type, {_review(kind)} as needs_review "
        f"from (select *, {CODE} as code from registry where {_work(kind)})"
        for kind, target in _TARGETS.items()
    ]
    targets.append(
        f"select sql_file_name, _stg_sql_file_md5, {_TRIGGER_PLAN} as new_sql, "
        "'Task' as new_type, true as needs_review from triggers"
    )
    updates = ("updates", " union all ".join(targets))
    return _ctes(*_registered("plain"), _TRIGGERS, updates) + (
        "select sql_file_name, _stg_sql_file_md5, stmt_type, object_type, "
        "new_sql as target_sql, new_type as target_object_type, "
        "case when new_sql is not null then '2024-05-02 12:00:00' end as updated_ts, needs_review "
        "from registry left join updates using (sql_file_name, _stg_sql_file_md5)"
    )


def _table_snapshot_sql() -> str:
    return _ctes(*_registered("plain")) + (
        "select sql_file_name, _stg_sql_file_md5, object_type, operation_type, "
        f"case when {_work('table')} then trim({_TABLE}, {_BLANKS}) end as target_sql, "
        f"case when {_work('table')} then 'Table' end as target_object_type, "
        f"case when {_work('table')} then {_review('table')} end as needs_review from registry"
    )


def _copy_sql() -> str:
    name = r"regexp_extract(target_sql, 'TABLE ([\w.]+)', 1)"
    return _ctes(*_registered("plain"), _translated("table", "plain")) + (
        f"select sql_file_name, _stg_sql_file_md5, format('COPY INTO {{}} FROM @DATA_STG/{{}}.csv "
        f"FILE_FORMAT = (TYPE = CSV) ON_ERROR = CONTINUE;', {name}, {name}) as copy_sql "
        "from translated"
    )


# --- lineage ------------------------------------------------------------------------

_EDGES = (
    "edges",
    rf"""
select distinct sql_file_name, _stg_sql_file_md5, upper(schema_name) as schema_name,
       upper(object_name) as object_name, depends_on
from (select sql_file_name, _stg_sql_file_md5, schema_name, object_name,
             unnest(regexp_extract_all({_sub(CODE, _DBO)},
                    '\b(?:FROM|JOIN)\s+([\w.]+)', 1)) as depends_on
      from registry where object_type = 'view' and operation_type = 'create')""",
)


# Levels of named nodes: the longest walk, of those that lead into no cycle.
_LEVELS = """
reach as (select name, reads from links union select r.name, e.reads from reach r join links e on e.name = r.reads),
cyclic as (select distinct name from reach where name = reads),
lost as (select name from cyclic union select r.name from reach r join cyclic c on r.reads = c.name),
walk as (
  select name, 0::bigint as depth from nodes where name not in (select name from lost)
  union
  select e.name, w.depth + 1 from walk w join links e on e.reads = w.name where e.name not in (select name from lost)
), levels as (select name, max(depth) as level from walk group by name)
select sql_file_name, _stg_sql_file_md5, schema_name, object_name, level,
       name in (select name from cyclic) as in_cycle
from nodes left join levels using (name)
"""


def _levels_sql() -> str:
    nodes = (
        "select sql_file_name, _stg_sql_file_md5, upper(schema_name) as schema_name, upper(object_name) as object_name, "
        "upper(object_name) as name from registry where object_type = 'view' and operation_type = 'create'"
    )
    links = "select distinct object_name as name, depends_on as reads from edges where depends_on in (select name from nodes)"
    named = _ctes(*_registered("plain"), _EDGES, ("nodes", nodes), ("links", links)).rstrip()
    return named.replace("with", "with recursive", 1) + ", " + _LEVELS


def _linked_levels_sql() -> str:
    """By the numbers that the scripts are made from, not by their texts."""
    return f"""
with recursive scripts as (
  select distinct string_split(path, '/')[-1] as sql_file_name, md5 as _stg_sql_file_md5, id
  from ({corpus_sql("linked", with_id=True)}) where regexp_full_match(path, '.*MS-SQL-Server-Script.*[.]sql')
), nodes as (
  select *, case when id % 20 < 10 then 'DBO' else 'SALES' end as schema_name, 'L_' || id as object_name, id as name
  from scripts
), links as (
  select * from (select id as name, unnest([case when id % 3 = 0 and id > 1 then 1 end, case when id % 10 not in (0, 6) then id - 1 end,
    case when id % 10 = 6 then id end, case when id % 10 = 7 then id + 1 end]) as reads
  from scripts)
  where reads in (select id from scripts)
), {_LEVELS}"""


def _complexity_sql(variant: str) -> str:
    counts = ", ".join(
        f"len(regexp_extract_all({CODE}, '{pattern}')) as {name}"
        for name, pattern in (
            ("n_joins", r"\bJOIN\b"),
            ("n_subselects", r"\(\s*SELECT\b"),
            ("n_groupings", r"\bGROUP\s+BY\b"),
        )
    )
    return _ctes(*_registered(variant)) + (
        "select *, case when n_joins + n_subselects + n_groupings = 0 then 'Simple' "
        "when n_joins + n_subselects + n_groupings <= 2 then 'Medium' "
        "when n_joins + n_subselects + n_groupings <= 5 then 'Complex' "
        "else 'Very Complex' end as complexity "
        f"from (select sql_file_name, _stg_sql_file_md5, {counts} from registry)"
    )


_DEPENDENCY_REPLIES = rf"""
select sql_file_name, _stg_sql_file_md5,
       unnest(range(1, len(lines) + 1)) as position, unnest(lines) as depends_on
from (select sql_file_name, md5 as _stg_sql_file_md5,
             list_transform(
               list_filter(string_split({DEPENDENCY_REPLY}, chr(10)),
                           lambda l: regexp_matches(l, '^\s*\d+\.')),
               lambda l: trim(regexp_replace(l, '^\s*\d+\.', ''))) as lines
      from scanned)"""

_SUMMARY_REPLIES = f"""
select sql_file_name, _stg_sql_file_md5, summary, expected_output, complexity,
       case when summary is null then 0
            else len(string_split(summary, ' ')) + len(string_split(expected_output, ' '))
       end as n_words,
       summary is not null as well_formed,
       n_words < 100 as within_limit,
       complexity is not null as known_label
from (select sql_file_name, md5 as _stg_sql_file_md5,
             case when reply <> 'No idea'
                  then replace(string_split(reply, chr(10))[1], 'Summary: ', '') end as summary,
             case when reply <> 'No idea' then 'rows' end as expected_output,
             case when reply like '%very complex.' then 'Very Complex'
                  when reply like '%Simple' then 'Simple' end as complexity
      from (select *, {SUMMARY_REPLY} as reply from scanned))"""


# --- prompts, completion, conversations ---------------------------------------------


def _prompt(task: str, body: str) -> str:
    head, tail = TEMPLATES[task]
    return (
        f"{_text(head)} || chr(10) || '<context>' || chr(10) || {body} || chr(10) "
        f"|| '</context>' || chr(10) || {_text(tail)}"
    )


_PROMPTS = " union all ".join(
    f"select path, '{task}' as task, {_prompt(task, 'sql_body')} as prompt from scanned"
    for task in TEMPLATES
)


def _completed(key: str, source: str, task: str, body: str) -> str:
    return (
        f"select {key}, case when digest[1] <> 'f' then digest end as response, "
        "case when digest[1] = 'f' then 'RuntimeError: refused' end as error "
        f"from (select {key}, md5({_prompt(task, body)}) as digest from {source})"
    )


_PIECES = (
    "pieces",
    r"""
select conv_id, turn,
       '<|im_start|>' || case when role = 'user' then 'user' else 'assistant' end
         || chr(10) || text || '<|im_end|>' as piece
from conversations""",
)
_WHOLE = (
    "whole",
    r"""
select conv_id, n_turns, prompt, len(regexp_extract_all(prompt, '[^ \t\n\f\r]+')) as n_units
from (select conv_id, count(*) as n_turns,
             string_agg(piece, chr(10) order by turn) || chr(10)
               || '<|im_start|>assistant' || chr(10) as prompt
      from pieces group by conv_id)""",
)


def _chat_prompt_sql(budget: int) -> str:
    return _ctes(_PIECES, _WHOLE) + (
        f"select conv_id, n_turns, n_units, n_units >= {budget} as refused, "
        f"case when n_units < {budget} then prompt end as prompt from whole"
    )


def _chat_budget_sql(budget: int) -> str:
    return _ctes(_PIECES, _WHOLE) + (
        f"select conv_id, n_turns, n_units, n_units >= {budget} as refused from whole"
    )


_PENDING = (
    "pending",
    "select conv_id, max(turn) as last_turn from conversations "
    "group by conv_id having arg_max(role, turn) <> 'assistant'",
)

_TITLE_CLASS = "".join("\\" + c for c in TITLE_DELIMITERS)
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, "
    + _text(f"[^{_TITLE_CLASS}]+|[{_TITLE_CLASS}]+")
    + "), lambda w: array_to_string(list_transform(string_split(w, ' '), "
    "lambda x: upper(x[1]) || lower(x[2:])), ' ')), '')"
)


def all_sql() -> dict[str, str]:
    plain = _ctes(*_registered("plain"))
    found = {
        "scan_scripts": _SCAN,
        "scan_files": _FILES,
        "preview_files": f"{_FILES} order by path limit 5",
        "scan_files_in_tasks": _FILES,
        "onboard_files": _ctes(*_registered("plain"), ("files", _FILES)) + _ONBOARDED,
        "batch_files": f"{_FILES} order by path limit 50",
        "preview_scripts": f"{_SCAN} order by path limit 5",
        "batch_scripts": f"{_SCAN} order by path limit 50",
        "tabulate_scripts": "select path as \"SQL_File_Name\", load_ts as \"Load_Time\", "
        f'md5 as "MD5", sql_body as "SQL_Body" from ({_SCAN})',
        "base_name": "select path, string_split(path, '/')[-1] as sql_file_name "
        f"from ({corpus_sql('plain')})",
        "load_time_text": "select event_id, "
        r"regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\.?0+$', '') "
        "as load_ts from events",
        "title_case": f"select p_partkey, {_TITLE.replace('{0}', 'label')} as title "
        "from (select p_partkey, p_type || '_' || p_name as label from part)",
        "parse_classification": _ctes(*_REPLIES)
        + "select path, stmt_type, object_type, operation_type, schema_name, object_name, fault "
        "from parsed",
        "classification_rejects": _ctes(*_REPLIES)
        + "select sql_file_name, path, md5, fault as reason, response from parsed "
        "where fault is not null",
        "new_scripts": _ctes(*_GOOD)
        + "select sql_file_name, md5, path, sql_body, stmt_type, object_type from good g "
        "where not exists (select 1 from good o where o.k % 5 = 0 "
        "and o.sql_file_name = g.sql_file_name and o.md5 = g.md5) "
        "qualify row_number() over (partition by sql_file_name, md5 order by path) = 1",
        "new_scripts_documents": _ctes(
            (
                "scripts",
                "select source as sql_file_name, md5(text) as md5, "
                "source || '/' || lpad(doc_id::varchar, 12, '0') as path, text as sql_body, doc_id "
                "from documents",
            )
        )
        + "select sql_file_name, md5, path, sql_body from scripts s "
        "where not exists (select 1 from scripts o where o.doc_id % 5 = 0 "
        "and o.sql_file_name = s.sql_file_name and o.md5 = s.md5) "
        "qualify row_number() over (partition by sql_file_name, md5 order by path) = 1",
        "registry_insert": _ctes(*_GOOD)
        + "select sql_file_name, sql_body, path as _stg_sql_file_name, "
        "load_ts as _stg_sql_file_load_ts, md5 as _stg_sql_file_md5, "
        "'Yes' as completion_worked, 'Completed' as completion_status, "
        "'None' as completion_err_msg, response as completion_response, "
        "stmt_type, object_type, operation_type, schema_name, object_name, "
        "null::varchar as target_sql, null::varchar as target_object_type, "
        "null::boolean as needs_review from good "
        "qualify row_number() over (partition by sql_file_name, md5 "
        "order by case when k % 5 = 0 then 0 else 1 end, path) = 1",
        "registry_scan": _ctes(*_registered("plain"))
        + "select sql_file_name, _stg_sql_file_md5, _stg_sql_file_name, sql_body, "
        "completion_response, stmt_type, object_type, operation_type, schema_name, object_name "
        "from registry",
        "complete_translation": _ctes(*_registered("plain"))
        + "select sql_file_name, _stg_sql_file_md5, digest as target_sql, "
        "'View' as target_object_type from (select sql_file_name, _stg_sql_file_md5, "
        f"md5({_prompt('view', 'sql_body')}) as digest from registry where {_work('view')}) "
        "where digest[1] <> 'f'",
        "complete_by_rules": _ctes(*_registered("plain"))
        + "select sql_file_name, _stg_sql_file_md5, null::varchar as error, "
        "array_to_string(list_transform(list_filter(names, lambda n, i: "
        "list_position(names, n) = i), lambda n, i: i || '. ' || n), chr(10)) as response "
        f"from (select *, regexp_extract_all({_sub(CODE, _DBO)}, "
        r"'\b(?:FROM|JOIN)\s+([\w.]+)', 1) as names "
        f"from registry where {_work('view')})",
        "apply_translation": _all_targets_sql(),
        "translate_registry": _all_targets_sql(),
        "apply_translation_snapshot": _table_snapshot_sql(),
        "object_type_stats": plain
        + "select upper(object_type[1]) || lower(object_type[2:]) as db_object_type, "
        "count(*) as object_count from registry where stmt_type = 'DDL' group by 1",
        "stmt_type_stats": plain
        + "select stmt_type as operation_type, count(*) as operation_count from registry "
        "group by 1",
        "copy_statement": _copy_sql(),
        "view_dependency_counts": _ctes(*_registered("plain"), _EDGES)
        + "select v.sql_file_name, v._stg_sql_file_md5, v.schema_name, v.object_name, "
        "count(e.depends_on) as n_dependencies from (select sql_file_name, _stg_sql_file_md5, "
        "upper(schema_name) as schema_name, upper(object_name) as object_name from registry "
        "where object_type = 'view' and operation_type = 'create') v "
        "left join edges e using (sql_file_name, _stg_sql_file_md5) group by 1, 2, 3, 4",
        "parse_dependency_reply": _ctes(*_classified("plain")) + _DEPENDENCY_REPLIES,
        "parse_summary_reply": _ctes(*_classified("plain")) + _SUMMARY_REPLIES,
        "build_prompt": _ctes(*_classified("plain")) + _PROMPTS,
        "complete": _ctes(*_classified("plain"))
        + _completed("path", "scanned", "classify", "sql_body"),
        "complete_documents": _completed("doc_id", "documents", "view_summary", "text"),
        "chat_prompt": _chat_prompt_sql(BUDGET),
        "chat_prompt_small_budget": _chat_prompt_sql(SMALL_BUDGET),
        "chat_budget": _chat_budget_sql(BUDGET),
        "chat_budget_small": _chat_budget_sql(SMALL_BUDGET),
        "chat_pending": _ctes(_PENDING) + "select * from pending",
        "chat_append": _ctes(_PENDING)
        + "select conv_id, turn, role, text from conversations union all "
        "select conv_id, last_turn + 1 as turn, 'assistant' as role, "
        "'reply to turn ' || last_turn as text from pending",
        "chat_answer": _ctes(_PENDING, _PIECES, _WHOLE)
        + "select conv_id, turn, role, text from conversations union all "
        "select conv_id, last_turn + 1 as turn, 'assistant' as role, md5(prompt) as text "
        f"from pending join whole using (conv_id) where n_units < {BUDGET} "
        "and md5(prompt)[1] <> 'f'",
        "chat_seed": "select distinct c_custkey as conv_id, 0::bigint as turn, "
        f"'assistant' as role, {_text(GREETING)} as text from customer "
        "where c_custkey not in (select conv_id from conversations)",
        "view_levels": _levels_sql(),
        "view_levels_linked": _linked_levels_sql(),
        "sql_query": SQL_TEXT,
        "single_column": COLUMN_TEXT,
    }
    for variant, suffix in (("plain", ""), ("annotated", "_annotated")):
        found[f"classify_scripts{suffix}"] = (
            _ctes(*_classified(variant))
            + "select sql_file_name, path, md5, response from classified"
        )
        found[f"trigger_headers{suffix}"] = (
            _ctes(*_registered(variant), _TRIGGERS) + "select * from triggers"
        )
        found[f"view_dependencies{suffix}"] = (
            _ctes(*_registered(variant), _EDGES) + "select * from edges"
        )
        found[f"script_complexity{suffix}"] = _complexity_sql(variant)
        for kind in WORKLIST_KINDS:
            found[f"translate_{kind}{suffix}"] = _translate_sql(kind, variant)
    for kind, limit in WORKLIST_LIMITS.items():
        load = "_stg_sql_file_load_ts, " if kind == "table" else ""
        sql = plain + (
            f"select sql_file_name, _stg_sql_file_md5, {load}sql_body from registry "
            f"where {_work(kind)}"
        )
        found[f"worklist_{kind}"] = sql
        if limit:
            found[f"worklist_{kind}_limit"] = (
                f"{sql} order by sql_file_name, _stg_sql_file_md5 limit {limit}"
            )
    for name in ("object_type_stats", "stmt_type_stats"):
        found[f"{name}_kept"] = found[name]
    found |= exported_sql(corpus_sql("exported", with_id=True))
    return found | nested_sql(corpus_sql("nested", with_id=True))
