"""Header-level script rules as column expressions.

They rewrite what a header states and flag the rest for review; a rule never
claims to have translated a procedural body.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.text import BLANKS, count_matches, map_code, strip

# --- classification -------------------------------------------------------------

_ID = r'(?:\[[^\]]*\]|"[^"]*"|[\w$#@]+)'
_NAME = rf"{_ID}(?:\s*\.\s*{_ID}?){{0,3}}"
_GAP = r"(?:\s|--[^\n]*|/\*.*?\*/)"
# What may precede the statement proper in an exported script.
_LEAD = rf"(?is)^(?:{_GAP}|;|GO\b|(?:USE|SET|PRINT|IF)\b[^\n;]*)*+"
_DROP_LEAD = rf"(?is)^(?:{_GAP}|;|GO\b|(?:USE|SET|PRINT|IF|DROP)\b[^\n;]*)*+"

# Statement kinds and the object kinds a header can name.
_DDL = "CREATE|ALTER|DROP|TRUNCATE"
_DML = "INSERT|UPDATE|DELETE|MERGE|SELECT|WITH"
_DCL = "GRANT|REVOKE|DENY"
_KINDS = (
    "TABLE|VIEW|FUNCTION|TRIGGER|PROCEDURE|PROC|INDEX|SCHEMA|SEQUENCE|TYPE|SYNONYM|"
    "DATABASE|LOGIN|USER|ROLE"
)


def _found(text: Column) -> Column:
    return F.when(text != "", text)


def _last_part(name: Column) -> Column:
    return _bare(F.regexp_extract(name, rf"({_ID})\s*$", 1))


def _bare(part: Column) -> Column:
    return _found(F.regexp_replace(part, r'^[\["]|[\]"]$', ""))


def statement_header(body: Column) -> Column:
    """Leading statement up to the name of its object; '' when none is recognised.

    Anchored at the start, so the cost is that of the header, not of the body.
    Leading DROP statements count as preamble when something follows them.
    """
    statement = (
        rf"(?:(?:CREATE(?:{_GAP}++OR{_GAP}++ALTER)?|ALTER|DROP|TRUNCATE)"
        rf"(?:{_GAP}++(?:UNIQUE|CLUSTERED|NONCLUSTERED))*{_GAP}++(?:{_KINDS})\b"
        rf"(?:{_GAP}++IF{_GAP}++(?:NOT{_GAP}++)?EXISTS\b)?(?:{_GAP}++{_NAME})?"
        rf"|(?:INSERT|MERGE)\b(?:{_GAP}++INTO\b)?(?:{_GAP}++{_NAME})?"
        rf"|DELETE\b(?:{_GAP}++FROM\b)?(?:{_GAP}++{_NAME})?"
        rf"|UPDATE\b(?:{_GAP}++{_NAME})?"
        rf"|(?:SELECT|WITH)\b"
        rf"|(?:{_DCL})\b[^;]*?\bON{_GAP}++(?:\w+\s*::\s*)?{_NAME}"
        rf"|(?:{_DDL}|{_DCL})\b)"
    )
    main = F.regexp_extract(body, rf"{_DROP_LEAD}({statement})", 1)
    return F.when(main != "", main).otherwise(F.regexp_extract(body, rf"{_LEAD}({statement})", 1))


def classify_header(header: Column) -> dict[str, Column]:
    """The five classification values of a statement header, null where not stated."""
    verb = F.upper(F.regexp_extract(header, r"^(\w+)", 1))
    is_ddl = verb.isin(_DDL.split("|"))
    kind = F.upper(F.regexp_extract(header, rf"(?i)\b({_KINDS})\b", 1))
    named = rf"(?is)(?:{_KINDS}|EXISTS|INTO|FROM|UPDATE|MERGE|INSERT|DELETE){_GAP}++({_NAME})$"
    name = F.when(
        verb.isin(_DCL.split("|")),
        F.regexp_extract(header, rf"(?is)\bON{_GAP}++(?:\w+\s*::\s*)?({_NAME})$", 1),
    ).otherwise(F.regexp_extract(header, named, 1))
    schema = F.regexp_extract(name, rf"({_ID})\s*\.\s*{_ID}\s*$", 1)
    return {
        "stmt_type": F.when(is_ddl, "DDL")
        .when(verb.isin(_DML.split("|")), "DML")
        .when(verb.isin(_DCL.split("|")), "DCL"),
        "object_type": F.when(
            is_ddl, _found(F.when(kind == "PROC", "procedure").otherwise(F.lower(kind)))
        ),
        "operation_type": F.when(verb.isin("CREATE", "ALTER"), F.lower(verb)),
        "schema_name": _bare(schema),
        "object_name": _last_part(name),
    }


# --- translation ----------------------------------------------------------------
# The inputs are `normalized` (upper case, no comments, no name delimiters) unless
# a rule says otherwise.

_ARGS = r"(?:\s*\(\s*[\w\s,.]*\))"
_TEXT_TYPE = (
    r"(?:NATIONAL\s+)?(?:N?VARCHAR|N?CHAR|CHARACTER)(?:\s+VARYING)?"
    rf"\b{_ARGS}?|(?:N?TEXT|STRING|SYSNAME)\b{_ARGS}?"
)
# A type is what follows a name; a name after "(" or "," may look like a type. What follows
# DEFAULT is a value: it is kept apart by a private-use mark while types are replaced.
_AFTER_NAME = r"([\w$#]\s+)"
_VALUE = "\ue002"

# A call of anything but these, or a name of three parts, is nothing the rules know.
_SAFE_CALLS = (
    "VARCHAR|NVARCHAR|CHAR|NCHAR|CHARACTER|VARYING|TEXT|DECIMAL|NUMERIC|FLOAT|TIME|KEY|CHECK|UNIQUE|"
    "DEFAULT|IN|AND|OR|NOT|ON|WHERE|HAVING|AS|FROM|JOIN|SELECT|BY|VALUES|RETURN|WHEN|THEN|ELSE|"
    "COUNT|SUM|AVG|MIN|MAX|COALESCE|NULLIF|UPPER|LOWER|LTRIM|RTRIM|TRIM|ABS|ROUND|FLOOR|CEILING|"
    "CAST|REPLACE|XML|JSON|OVER|ROW_NUMBER|RANK|DENSE_RANK"
)
_OBJECT = r"\b(?:TABLE|VIEW|FUNCTION|REFERENCES|INTO)\s+[\w$#]+(?:\s*\.\s*[\w$#]*)*"
_BEFORE_OBJECT = "CONTENT|DOCUMENT|TABLE|VIEW|FUNCTION|TRIGGER|REFERENCES|ON|FROM|JOIN|INTO|UPDATE|EXISTS|ADD|AS|RETURN|SELECT"


def unknown_construct(code: Column) -> Column:
    """True for a call that is not known to mean the same, a name of three parts, or N'...'.

    The code is upper case and its literals are empty.
    """
    bare = drop_dbo(F.regexp_replace(code, _OBJECT, " KEY "))
    return (
        F.rlike(bare, F.lit(rf"(?<![\w$#.@])(?!(?:{_SAFE_CALLS})\b)[A-Z_#][\w$#]*+\s*+\("))
        | F.rlike(bare, F.lit(r"[\w$#]\s*+\.\s*+[A-Z_][\w$#]*+\s*+\("))
        | F.rlike(drop_dbo(code), F.lit(r"(?<![\w$#.])[A-Z_#][\w$#]*+\s*+\.\s*+[\w$#]*+\s*+\."))
        | F.rlike(code, F.lit(r"\bN'"))
    )


def schema_type(code: Column) -> Column:
    """True when a type is named with its schema: a name follows another name."""
    return F.rlike(
        code, F.lit(rf"(?<![\w$#.@])(?!(?:{_BEFORE_OBJECT})\b)[A-Z_#@][\w$#]*+\s++(?:DBO|SYS)\s*+\.")
    )


_SETTINGS = r"ANSI_NULLS|ANSI_PADDING|ANSI_WARNINGS|ARITHABORT|QUOTED_IDENTIFIER|NOCOUNT|XACT_ABORT"


def statements_only(text: Column) -> Column:
    """Comment-free script text without session settings; batch ends become semicolons."""

    def rule(code: Column) -> Column:
        code = F.regexp_replace(
            code,
            rf"(?im)^[ \t]*(?:USE[ \t]+[\w$#]+|SET[ \t]+(?:{_SETTINGS})[ \t]+(?:ON|OFF))[ \t;]*$",
            "",
        )
        code = F.regexp_replace(code, r"(?im)^[ \t]*GO(?:[ \t]+\d+)?[ \t;]*$", ";")
        return F.regexp_replace(code, r"(?<!\s)\s*;[\s;]*", ";\n")

    return F.btrim(map_code(text, rule), F.lit(BLANKS + ";"))


def several_statements(code: Column) -> Column:
    """True when code follows a semicolon."""
    return F.rlike(code, F.lit(r";\s*\S"))


def drop_dbo(code: Column) -> Column:
    """Without the default schema, where it is the first part of a name."""
    return F.regexp_replace(code, r"(?i)(?<![\w$#.])(?<!\.\s)DBO\s*\.\s*", "")


def _table_rules(code: Column) -> Column:
    code = F.regexp_replace(drop_dbo(code), r"\bDEFAULT(\s+)", f"DEFAULT$1{_VALUE}")
    code = F.regexp_replace(code, rf"{_AFTER_NAME}(?:{_TEXT_TYPE})", "$1TEXT")
    code = F.regexp_replace(code, rf"{_AFTER_NAME}(?:XML|JSON)\b{_ARGS}?", "$1VARIANT")
    code = F.translate(code, _VALUE, "")
    return F.regexp_replace(code, r"\bCREATE\s+TABLE\b", "CREATE OR REPLACE TABLE")


def table_ddl(text: Column) -> Column:
    return strip(map_code(text, _table_rules))


def table_review(text: Column) -> Column:
    """True when the table uses a feature that the header rules leave as it is."""
    return unknown_construct(text) | schema_type(text) | F.rlike(
        text,
        F.lit(
            r"\b(?:IDENTITY|CLUSTERED|NONCLUSTERED|ON\s+PRIMARY|TEXTIMAGE_ON|PERSISTED|ROWGUIDCOL"
            r"|SPARSE|COLLATE|UNIQUEIDENTIFIER|SMALLMONEY|MONEY|BIT|DATETIME|SMALLDATETIME"
            r"|DATETIME2|DATETIMEOFFSET|VARBINARY|IMAGE|HIERARCHYID|GEOGRAPHY|GEOMETRY"
            r"|SQL_VARIANT|ROWVERSION|TINYINT|GETDATE|NEWID)\b|\bWITH\s*\(|\bAS\s*\(|\)\s*ON\s+[\w$#]+"
        ),
    )


def table_name(ddl: Column) -> Column:
    """Name of the table a translated DDL creates; null when it creates none."""
    return _found(
        F.regexp_extract(ddl, r"\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+([\w$#]+(?:\.[\w$#]+)*)", 1)
    )


def copy_statement(name: Column) -> Column:
    """Load statement of a table: a CSV file named like it, continuing on errors."""
    return F.concat(
        F.lit("COPY INTO "),
        name,
        F.lit(" FROM @DATA_STG/"),
        F.element_at(F.split(name, r"\."), -1),
        F.lit(".csv FILE_FORMAT = (TYPE = CSV) ON_ERROR = CONTINUE;"),
    )


def constraint_ddl(text: Column) -> Column:
    return strip(map_code(text, drop_dbo))


def constraint_review(text: Column) -> Column:
    return F.rlike(
        text, F.lit(r"\b(?:WITH\s+(?:NO)?CHECK|CHECK\s+CONSTRAINT|CLUSTERED|NONCLUSTERED)\b")
    )


def _function_rules(code: Column) -> Column:
    code = F.regexp_replace(code, r"@+([A-Za-z_#])", "$1")
    code = F.regexp_replace(code, r"(?i)\bCREATE\s+OR\s+ALTER\s+FUNCTION\b", "CREATE OR REPLACE FUNCTION")
    code = F.regexp_replace(code, rf"(?i)\bRETURNS(\s+)(?:{_TEXT_TYPE})", "RETURNS$1TEXT")
    return F.regexp_replace(
        code,
        rf"(?i)\b(RETURNS\s+(?:TABLE|[A-Z]\w*(?:\s*\.\s*\w+)?{_ARGS}?))(\s+(?:WITH\b|AS\b|BEGIN\b|RETURN\b))",
        "$1 LANGUAGE SQL$2",
    )


def function_ddl(text: Column) -> Column:
    """Function rules keep case and schema; the text is `bare_names`."""
    return strip(map_code(text, _function_rules))


def has_declare(code: Column) -> Column:
    return F.rlike(code, F.lit(r"\bDECLARE\b"))


def has_branch(code: Column) -> Column:
    return F.rlike(code, F.lit(r"\b(?:IF|ELSE)\b"))


def function_review(code: Column) -> Column:
    """True for anything but a plain scalar function (code is `code_only`)."""
    return (
        has_declare(code)
        | has_branch(code)
        | unknown_construct(code)
        | schema_type(code)
        | F.rlike(code, F.lit(r"^\s*ALTER\b|\bRETURNS\s+\w+\s*\."))
        | F.rlike(
            code, F.lit(r"\bRETURNS\s+(?:@\w+\s+)?TABLE\b|@@|\b(?:WHILE|EXEC|WITH)\b|#\w")
        )
    )


# What the select list of a view is read by: literals, brackets, commas, words, the rest. FROM
# after DISTINCT belongs to a comparison.
_WORD_END = r"(?![\w$#@])"
_LIST_TOKEN = rf"'[^']*+'?|[(),]|DISTINCT\s++FROM{_WORD_END}|[\w$#@]++|[^\w$#@'(),]++"
# Words that end a select list when they stand in no bracket of it.
_LIST_ENDS = ["FROM", "UNION", "EXCEPT", "INTERSECT", "WHERE", "GROUP", "HAVING", "ORDER", "WITH", "INTO", "OPTION"]
# Marks between the columns of a list and after it; private-use characters.
_LIST_NEXT, _LIST_CLOSE = "\ue003", "\ue004"
# Tokens of a block. A fold copies its state at every step, so none runs over more.
_BLOCK = 400


def _view_rules(code: Column) -> Column:
    return F.regexp_replace(
        drop_dbo(code), r"\bCREATE\s+(?:OR\s+ALTER\s+)?VIEW\b", "CREATE OR REPLACE VIEW"
    )


def view_header(text: Column) -> Column:
    """View DDL before its select list is laid out."""
    return strip(map_code(text, _view_rules))


def _tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s){_LIST_TOKEN}"), F.lit(0))


def view_parts(ddl: Column) -> tuple[Column, Column]:
    """The text up to the first SELECT, with DISTINCT or ALL, and what comes after it."""
    toks = _tokens_of(ddl)
    place = F.array_position(toks, "SELECT").cast("int")
    rest = F.when(place > 0, F.array_join(F.slice(toks, place + 1, F.greatest(F.size(toks) - place, F.lit(0))), ""))
    lead = rf"^(\s+(?:DISTINCT|ALL){_WORD_END})"
    head = F.concat(F.array_join(F.slice(toks, 1, place), ""), F.regexp_extract(rest, lead, 1))
    return F.when(place > 0, head), F.regexp_replace(rest, lead, "")


def list_blocks(rest: Column) -> Column:
    """The text after SELECT in blocks of whole tokens, with the brackets open before each."""
    blocks = F.regexp_extract_all(rest, F.lit(rf"(?s)(?:{_LIST_TOKEN}){{1,{_BLOCK}}}"), F.lit(0))

    def opened(block: Column) -> Column:
        code = F.regexp_replace(block, "'[^']*+'?", "")
        return F.regexp_count(code, F.lit(r"\(")) - F.regexp_count(code, F.lit(r"\)"))

    before = F.aggregate(
        blocks,
        F.array(F.lit(0)),
        lambda sums, block: F.array_append(sums, F.element_at(sums, -1) + opened(block)),
        lambda sums: F.slice(sums, 1, F.size(sums) - 1),
    )
    return F.arrays_zip(blocks.alias("block"), before.alias("open"))


def marked_list(blocks: Column) -> Column:
    """The blocks as one text, with a mark in the place of each comma between columns and one
    after the list. Commas inside of brackets and literals are left.

    Every block is read by a fold over its tokens that counts open brackets, as though the
    list went on up to it; the first block in which it ends settles that.
    """

    def step(done: Column, tok: Column) -> Column:
        here = (done["open"] == 0) & ~done["over"]
        ends = here & (tok.isin(_LIST_ENDS) | (tok == ")"))
        made = F.when(here & (tok == ","), _LIST_NEXT).when(ends, F.concat(F.lit(_LIST_CLOSE), tok)).otherwise(tok)
        return F.struct(
            (done["open"] + F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)).alias("open"),
            (done["over"] | ends).alias("over"),
            F.concat(done["text"], made).alias("text"),
        )

    def read(entry: Column) -> Column:
        start = F.struct(entry["open"].alias("open"), F.lit(False).alias("over"), F.lit("").alias("text"))
        return F.aggregate(_tokens_of(entry["block"]), start, step)

    done = F.transform(blocks, read)

    def settle(found: Column) -> Column:
        end = F.array_position(F.transform(found, lambda f: f["over"]), True)
        texts = F.transform(
            F.arrays_zip(found.alias("found"), blocks.alias("raw")),
            lambda e, i: F.when((end == 0) | (i < end), e["found"]["text"]).otherwise(e["raw"]["block"]),
        )
        closed = (end > 0) | (F.try_element_at(found, F.lit(-1))["open"] == 0)
        return F.struct(F.array_join(texts, "").alias("text"), F.coalesce(closed, F.lit(False)).alias("closed"))

    # A one-element array keeps what was read from being read again.
    return F.get(F.transform(F.array(done), settle), F.lit(0))


def list_columns(marked: Column) -> Column:
    """The columns of a `marked_list`; null when no list was found, a bracket of it stays open
    or a column is missing."""
    parts = F.split(marked["text"], _LIST_CLOSE, 2)
    columns = F.transform(F.split(F.get(parts, F.lit(0)), _LIST_NEXT), strip)
    return F.when(marked["closed"] & ~F.exists(columns, lambda c: c == ""), columns)


def view_ddl(ddl: Column, head: Column, marked: Column, columns: Column) -> Column:
    """Put each column of the select list on its own line, where the list is clear."""
    rest = strip(F.coalesce(F.get(F.split(marked["text"], _LIST_CLOSE, 2), F.lit(1)), F.lit("")))
    laid_out = F.concat(
        head,
        F.lit("\n    "),
        F.array_join(columns, ",\n    "),
        F.when(rest != "", F.concat(F.lit("\n"), rest)).otherwise(""),
    )
    return F.when(columns.isNotNull(), laid_out).otherwise(ddl)


def view_review(ddl: Column, columns: Column) -> Column:
    return (
        columns.isNull()
        | unknown_construct(ddl)
        | (count_matches(ddl, r"\bSELECT\b") > 1)
        | F.rlike(ddl, F.lit(r"\b(?:TOP|APPLY|PIVOT|SCHEMABINDING|NOLOCK|ISNULL|GETDATE)\b"))
    )


_TRIGGER = (
    rf"(?is)\bCREATE\s+(?:OR\s+ALTER\s+)?TRIGGER\s+({_NAME})\s+ON\s+({_NAME})\s+"
    r"(?:WITH(?:\s++(?!(?:AFTER|FOR|INSTEAD)\b)[\w,']++)++\s++)?(AFTER|FOR|INSTEAD\s+OF)\s+"
    r"((?:INSERT|UPDATE|DELETE)(?:\s*,\s*(?:INSERT|UPDATE|DELETE))*)"
    r"(?:\s+WITH\s+APPEND)?(?:\s+NOT\s+FOR\s+REPLICATION)?\s+AS\b\s*(.*)$"
)


def trigger_parts(text: Column) -> dict[str, Column]:
    """Header fields and verbatim body of a trigger (text is `bare_names`)."""

    def part(group: int) -> Column:
        return F.regexp_extract(text, _TRIGGER, group)

    return {
        "trigger_name": _found(drop_dbo(F.upper(part(1)))),
        "target_table": _found(drop_dbo(F.upper(part(2)))),
        "timing": _found(F.regexp_replace(F.upper(part(3)), r"\s+", " ")),
        "events": _found(F.regexp_replace(F.upper(part(4)), r"\s*,\s*", ",")),
        "trigger_body": _found(strip(map_code(part(5), drop_dbo))),
    }


def trigger_plan(name: Column, table: Column, events: Column, body: Column) -> Column:
    """Procedure first, then the task that calls it."""
    return F.concat(
        F.lit("CREATE OR REPLACE PROCEDURE "),
        name,
        F.lit("_PROC()\nRETURNS TEXT\nLANGUAGE SQL\nAS\n$$\nBEGIN\n    "),
        body,
        F.lit("\nEND\n$$;\n\n-- Replaces the trigger on "),
        table,
        F.lit(" for "),
        events,
        F.lit("\nCREATE OR REPLACE TASK "),
        name,
        F.lit("_TASK\n    SCHEDULE = '1 MINUTE'\nAS\n    CALL "),
        name,
        F.lit("_PROC();"),
    )


# --- lineage --------------------------------------------------------------------

_CODE_NAME = r"[\w$#]+(?:\s*\.\s*[\w$#]*){0,3}"
# What may stand between a name and a comma that goes on with the list: an alias, hints.
_ALIAS = r"(?:\s+(?:AS\s+)?(?!(?:WITH|ON|WHERE|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|OUTER|GROUP|ORDER|HAVING|UNION)\b)[\w$#]+)?"
_HINTS = r"\s*(?:WITH\s*)?\((?:\s*,?\s*(?:NOLOCK|READPAST|READUNCOMMITTED|READCOMMITTED|HOLDLOCK|UPDLOCK|ROWLOCK|TABLOCK|FORCESEEK|SNAPSHOT|INDEX\s*\([^()]*\)))+\s*\)"
_HINT = rf"(?:{_HINTS})?"
_LIST = rf"{_CODE_NAME}{_ALIAS}{_HINT}(?:\s*,\s*{_CODE_NAME}{_ALIAS}{_HINT})*+"
_SOURCES = rf"\b(?:FROM|JOIN)[\s(]+(?!SELECT\b)({_LIST})"
# After a join condition a comma goes on with the FROM list; in a select list it cannot.
_AFTER_ON = rf"\bON\b(?:(?!\b(?:WHERE|GROUP|ORDER|HAVING|UNION|SELECT|WHEN|JOIN)\b)[^,()]|\([^()]*\))*+,\s*({_LIST})"
_CTE = r"(?:\bWITH|,)\s*+([\w$#]+)\s*+(?:\([^()]*\)\s*+)?AS\s*+\("
# FROM that opens no list of sources.
_NO_SOURCE = r"\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b|\b(?:TRIM|SUBSTRING|EXTRACT)\s*\([^()]*\)"


def _after_conditions(code: Column) -> Column:
    """Lists that go on after a join condition, whatever brackets it holds.

    Innermost brackets are blanked until none is left; on the way each condition comes to
    stand without any. A list is looked for at each step, as its own bracket goes later.
    """

    def found(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(_AFTER_ON), F.lit(1))

    def step(done: Column, _: Column) -> Column:
        blank = F.regexp_replace(done["text"], r"\([^()]*\)", " ")
        made = F.transform(
            F.array(blank),
            lambda t: F.struct(
                t.alias("text"), F.concat(done["lists"], found(t)).alias("lists"), (t == done["text"]).alias("over")
            ),
        )
        return F.when(done["over"], done).otherwise(F.element_at(made, 1))

    start = F.struct(
        F.regexp_replace(code, _HINTS, " ").alias("text"), found(code).alias("lists"), F.lit(False).alias("over")
    )
    opened = F.length(F.regexp_replace(code, r"[^(]+", ""))
    nested = F.aggregate(F.sequence(F.lit(0), opened), start, step, lambda done: F.array_distinct(done["lists"]))
    return F.when(code.rlike(r"\bON\b") & code.contains("(") & code.contains(","), nested).otherwise(found(code))


def source_names(code: Column) -> Column:
    """Distinct names a query reads, without the ones it declares itself.

    Follows FROM and JOIN, also in brackets, and lists that go on after a comma, past hints
    and join conditions. `code` is `code_only`.
    """
    code = F.regexp_replace(code, _NO_SOURCE, " ")
    lists = F.concat(
        F.regexp_extract_all(code, F.lit(_SOURCES), F.lit(1)),
        _after_conditions(code),
    )
    bare = F.transform(lists, lambda s: F.regexp_replace(s, r"\([^()]*(?:\([^()]*\)[^()]*)*\)", " "))
    names = F.flatten(F.transform(bare, lambda s: F.split(s, ",")))
    names = F.transform(
        names,
        lambda n: drop_dbo(
            F.regexp_replace(F.regexp_extract(n, rf"^\s*({_CODE_NAME})", 1), r"\s+", "")
        ),
    )
    own = F.regexp_extract_all(code, F.lit(_CTE), F.lit(1))
    return F.array_distinct(F.array_except(names, own))


def complexity_points(code: Column) -> dict[str, Column]:
    return {
        "n_joins": count_matches(code, r"\bJOIN\b"),
        "n_subselects": count_matches(code, r"\(\s*SELECT\b"),
        "n_groupings": count_matches(code, r"\bGROUP\s+BY\b"),
    }


# The four labels. The thresholds are this library's own.
COMPLEXITY_LABELS = ["Simple", "Medium", "Complex", "Very Complex"]


def complexity_label(points: Column) -> Column:
    simple, medium, complex_, very = COMPLEXITY_LABELS
    return (
        F.when(points == 0, simple)
        .when(points <= 2, medium)
        .when(points <= 5, complex_)
        .otherwise(very)
    )
