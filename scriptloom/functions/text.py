"""Text functions on columns.

The patterns for script text keep to repeats of single character classes, possessive
groups and starting points that a failed attempt cannot revisit. A script of any
length is processed whole, in time linear in it and without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token of script text: a literal, a comment, a delimited name, or plain code.
TOKEN = (
    r"(?s)'[^']*'?"
    r"|--[^\n]*"
    r"|/\*.*?(?:\*/|\z)"
    r"|\[[^\]]*\]?"
    r'|"[^"]*"?'
    r"""|[^'"\[/-]+"""
    r"|."
)

BLANKS = " \t\r\n"

# Words that the target reserves; as names they keep needing delimiters.
RESERVED = (
    "ACCOUNT ALL ALTER AND ANY AS BETWEEN BY CASE CAST CHECK COLUMN CONNECT CONNECTION CONSTRAINT "
    "CREATE CROSS CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER DATABASE DELETE "
    "DISTINCT DROP ELSE EXISTS FALSE FOLLOWING FOR FROM FULL GRANT GROUP HAVING ILIKE IN INCREMENT "
    "INNER INSERT INTERSECT INTO IS ISSUE JOIN LATERAL LEFT LIKE LOCALTIME LOCALTIMESTAMP MINUS "
    "NATURAL NOT NULL OF ON OR ORDER ORGANIZATION QUALIFY REGEXP REVOKE RIGHT RLIKE ROW ROWS SAMPLE "
    "SCHEMA SELECT SET SOME START TABLE TABLESAMPLE THEN TO TRIGGER TRUE TRY_CAST UNION UNIQUE "
    "UPDATE USER USING VALUES VIEW WHEN WHENEVER WHERE WITH"
).split()

# Marks around a bare name while tokens are glued; private-use characters.
_OPEN, _CLOSE = "\ue000", "\ue001"

# Characters after which title case starts a new word, besides white space.
TITLE_DELIMITERS = r"""!?@"^#$&~_,.:;+-*%/|\[](){}<>"""


def base_name(path: Column) -> Column:
    """Text after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def strip(value: Column) -> Column:
    """The text without blanks and line breaks around it."""
    return F.btrim(value, F.lit(BLANKS))


def title_case(value: Column, delimiters: str = TITLE_DELIMITERS) -> Column:
    """First letter of each word upper, the rest lower; words end at any delimiter."""
    if not delimiters:
        return F.initcap(value)
    cls = "".join("\\" + c for c in delimiters)
    words = F.regexp_extract_all(value, F.lit(rf"[^{cls}]+|[{cls}]+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def word_count(value: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(value, F.lit(r"[^ \t\n\f\r]+")).cast("bigint")


def count_matches(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("bigint")


def tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))


def _is_comment(token: Column) -> Column:
    return token.startswith("--") | token.startswith("/*")


def _is_delimited(token: Column) -> Column:
    closed = (token.startswith("[") & token.endswith("]")) | (
        token.startswith('"') & token.endswith('"')
    )
    return closed & (F.length(token) > 1)


def _undelimit(token: Column) -> Column:
    return token.substr(F.lit(2), F.length(token) - 2)


def _regular(name: Column) -> Column:
    """The name with an underscore for each character it could not have undelimited."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_$#@]", "_")


def _render(toks: Column, literal: Callable[[Column], Column], upper: bool) -> Column:
    """Glue tokens back: comments become a space, delimited names become bare ones."""
    fold = F.upper if upper else (lambda c: c)

    def one(tok: Column) -> Column:
        return (
            F.when(tok.startswith("'"), literal(tok))
            .when(_is_comment(tok), F.lit(" "))
            .when(
                _is_delimited(tok),
                F.concat(F.lit(_OPEN), fold(_regular(_undelimit(tok))), F.lit(_CLOSE)),
            )
            .otherwise(fold(tok))
        )

    glued = F.array_join(F.transform(toks, one), "")
    # A name that touched its neighbour only through its delimiters needs a space now.
    glued = F.regexp_replace(glued, f"{_CLOSE}{_OPEN}", " ")
    glued = F.regexp_replace(glued, rf"{_CLOSE}(\w)", " $1")
    glued = F.regexp_replace(glued, rf"(\w){_OPEN}", "$1 ")
    return F.translate(glued, _OPEN + _CLOSE, "")


def normalized(toks: Column) -> Column:
    """Upper-case script text without comments and name delimiters; literals unchanged.

    Keywords are upper-cased along with the names.
    """
    return _render(toks, lambda t: t, upper=True)


def bare_names(toks: Column) -> Column:
    """As `normalized`, but the case is kept."""
    return _render(toks, lambda t: t, upper=False)


def code_only(toks: Column) -> Column:
    """Upper-case code for counting and name extraction: literals are emptied."""
    return _render(toks, lambda t: F.lit("''"), upper=True)


def has_irregular_name(toks: Column) -> Column:
    """True when a delimited name would not be valid, or a reserved word, without its delimiters."""
    return F.exists(
        toks,
        lambda t: _is_delimited(t)
        & (
            ~F.rlike(_undelimit(t), F.lit(r"^[A-Za-z_@#][\w$@#]*$"))
            | F.upper(_undelimit(t)).isin(RESERVED)
        ),
    )


def map_code(text: Column, rule: Callable[[Column], Column]) -> Column:
    """Apply a rule outside string literals only. The text must be free of comments."""
    return F.array_join(
        F.transform(F.split(text, "'"), lambda s, i: F.when(i % 2 == 0, rule(s)).otherwise(s)), "'"
    )


def without_literals(text: Column) -> Column:
    """The text with its string literals emptied. It must be free of comments."""
    return F.array_join(
        F.transform(F.split(text, "'"), lambda s, i: F.when(i % 2 == 0, s).otherwise("")), "'"
    )
