"""Reading what a completion service answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.rules import COMPLEXITY_LABELS
from scriptloom.functions.text import BLANKS, strip, word_count
from scriptloom.schema import CLASS_KEYS

_STRICT = {"allowSingleQuotes": "false"}
_JSON_STRING = r'(?s)"(?:[^"\\]|\\.)*+"'


def json_readings(reply: Column) -> dict[str, Column]:
    """Two readings of a reply that together tell whether it is exactly one JSON object.

    A lone `from_json` accepts text after the object. Wrapping the reply once as the
    only array element and once as the only member value rules that out.
    """
    as_array = F.from_json(
        F.concat(F.lit("["), reply, F.lit("]")), "array<map<string,string>>", _STRICT
    )
    as_member = F.from_json(
        F.concat(F.lit('{"w":'), reply, F.lit("}")), "map<string,map<string,string>>", _STRICT
    )
    # The parser takes a signed infinity, which JSON readers elsewhere do not.
    signed = F.when(
        reply.contains("+I"), F.rlike(F.regexp_replace(reply, _JSON_STRING, ""), F.lit(r"\+I"))
    ).otherwise(F.lit(False))
    return {"__elements": as_array, "__whole": as_member.isNotNull() & ~signed}


def json_object(elements: Column, whole: Column) -> Column:
    """The reply as a string map when its readings agree on one object, else null."""
    return F.when((F.size(elements) == 1) & whole, F.get(elements, F.lit(0)))


def json_value(fields: Column, key: str) -> Column:
    """Value of a key; the last one counts when the object repeats it."""
    matching = F.map_values(F.map_filter(fields, lambda k, _: k == key))
    return F.try_element_at(matching, F.lit(-1))


def classification_fault(reply: Column, fields: Column) -> Column:
    """Why a classification reply is unusable; null when it is fine."""
    fault = F.when(reply.isNull(), "no reply").when(fields.isNull(), "not a JSON object")
    for key in CLASS_KEYS:
        fault = fault.when(~F.map_contains_key(fields, key), f"missing key: {key}")
    return fault


_SUMMARY = (
    r"(?is)\bSummary\s*:(.*?)"
    r"\bExpected\s+Output\s*:(.*?)"
    r"\b(?:Query\s+)?Complexity\s*:(.*)$"
)

# Fixed value: a summary must stay below this many words.
SUMMARY_WORD_LIMIT = 100


def summary_parts(reply: Column) -> dict[str, Column]:
    """The three labelled parts of a summary reply, null where missing or empty."""

    def part(group: int) -> Column:
        text = strip(F.regexp_extract(reply, _SUMMARY, group))
        return F.when(text != "", text)

    return {
        "summary": part(1),
        "expected_output": part(2),
        "label": F.rtrim(part(3), F.lit(BLANKS + ".")),
    }


def summary_checks(summary: Column, output: Column, label: Column) -> dict[str, Column]:
    """The known complexity label, and whether the reply kept to the request."""
    known = F.lit(None).cast("string")
    for name in COMPLEXITY_LABELS:
        known = F.when(F.lower(label) == name.lower(), name).otherwise(known)
    words = F.coalesce(word_count(summary), F.lit(0)) + F.coalesce(word_count(output), F.lit(0))
    return {
        "complexity": known,
        "n_words": words.cast("bigint"),
        "well_formed": summary.isNotNull() & output.isNotNull() & label.isNotNull(),
        "within_limit": words < SUMMARY_WORD_LIMIT,
        "known_label": known.isNotNull(),
    }


def dependency_lines(reply: Column) -> Column:
    """Entries of a numbered list, in order."""
    return F.regexp_extract_all(reply, F.lit(r"(?m)^[ \t]*\d+\.[ \t]*([^\r\n]*[^\s])"), F.lit(1))
