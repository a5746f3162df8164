"""Views whose select lists are nested, with what is expected of each written out by hand.

`~id~` stands for the script's number.
"""

from __future__ import annotations

MARK = "~id~"

#: Text, expected translation, expected review mark.
TEMPLATES = [
    (
        "CREATE VIEW dbo.n~id~ AS SELECT coalesce(upper(a.nm), 'none, at all (yet)') nm, "
        "round(sum(b.qty * (1 + b.tax)), 2) AS total, count(*) FROM dbo.a~id~ a JOIN [dbo].[b] b ON a.id = b.id GROUP BY a.nm",
        "CREATE OR REPLACE VIEW N~id~ AS SELECT\n    COALESCE(UPPER(A.NM), 'none, at all (yet)') NM,\n"
        "    ROUND(SUM(B.QTY * (1 + B.TAX)), 2) AS TOTAL,\n    COUNT(*)\n"
        "FROM A~id~ A JOIN B B ON A.ID = B.ID GROUP BY A.NM",
        False,
    ),
    (
        "CREATE VIEW dbo.c~id~ AS\nSELECT DISTINCT CASE WHEN a IN (1, 2) THEN 'x(' WHEN b IS NOT DISTINCT FROM c THEN ',' "
        "ELSE cast(a AS decimal(10, 2)) END k,\n [b]\nFROM dbo.t~id~ WHERE a > 0",
        "CREATE OR REPLACE VIEW C~id~ AS\nSELECT DISTINCT\n    CASE WHEN A IN (1, 2) THEN 'x(' WHEN B IS NOT DISTINCT FROM C "
        "THEN ',' ELSE CAST(A AS DECIMAL(10, 2)) END K,\n    B\nFROM T~id~ WHERE A > 0",
        False,
    ),
    (
        "CREATE VIEW dbo.s~id~ AS SELECT a, (SELECT max(x) FROM dbo.s WHERE s.id = t.id) mx, b FROM dbo.t~id~ t",
        "CREATE OR REPLACE VIEW S~id~ AS SELECT\n    A,\n    (SELECT MAX(X) FROM S WHERE S.ID = T.ID) MX,\n    B\nFROM T~id~ T",
        True,
    ),
    (
        "CREATE VIEW dbo.one~id~ (a, b) AS SELECT 1 AS a, (2 + (3 * 4)) AS b",
        "CREATE OR REPLACE VIEW ONE~id~ (A, B) AS SELECT\n    1 AS A,\n    (2 + (3 * 4)) AS B",
        False,
    ),
    (
        "CREATE VIEW dbo.q~id~ AS SELECT a, (b FROM dbo.t~id~",
        "CREATE OR REPLACE VIEW Q~id~ AS SELECT A, (B FROM T~id~",
        True,
    ),
    (
        "CREATE VIEW dbo.u~id~ AS SELECT max(coalesce(a, 0)) m, b FROM dbo.x~id~ GROUP BY b UNION SELECT c, d FROM dbo.y",
        "CREATE OR REPLACE VIEW U~id~ AS SELECT\n    MAX(COALESCE(A, 0)) M,\n    B\nFROM X~id~ GROUP BY B UNION SELECT C, D FROM Y",
        True,
    ),
    (
        "CREATE VIEW dbo.r~id~ AS SELECT row_number() OVER (PARTITION BY a, lower(b) ORDER BY c) rn, -- a, b\n a FROM dbo.t~id~",
        "CREATE OR REPLACE VIEW R~id~ AS SELECT\n    ROW_NUMBER() OVER (PARTITION BY A, LOWER(B) ORDER BY C) RN,\n    A\nFROM T~id~",
        False,
    ),
    (
        "CREATE VIEW dbo.e~id~ AS SELECT a, , b FROM dbo.t~id~",
        "CREATE OR REPLACE VIEW E~id~ AS SELECT A, , B FROM T~id~",
        True,
    ),
    (
        "CREATE VIEW dbo.d~id~ AS SELECT [first, last], dbo.fullname(a, b) n FROM dbo.t~id~",
        "CREATE OR REPLACE VIEW D~id~ AS SELECT\n    FIRST__LAST,\n    FULLNAME(A, B) N\nFROM T~id~",
        True,
    ),
]


def _by_template(values: list) -> str:
    """SQL that gives each script the value of its template."""

    def literal(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        quoted = value.replace("'", "''")
        return f"replace('{quoted}', '{MARK}', cast(id as string))"

    whens = " ".join(f"when {k} then {literal(v)}" for k, v in enumerate(values))
    return f"case id % {len(TEMPLATES)} {whens} end"


def body_sql() -> str:
    """The text of script `id`; Spark and DuckDB run it alike."""
    return _by_template([body for body, _, _ in TEMPLATES])


def nested_sql(corpus: str) -> dict[str, str]:
    """Expected rows of `translate_view_nested`."""
    target, review = (_by_template([t[k] for t in TEMPLATES]) for k in (1, 2))
    return {
        "translate_view_nested": f"""
select distinct string_split(path, '/')[-1] as sql_file_name, md5 as _stg_sql_file_md5, {target} as target_sql,
       'View' as target_object_type, {review} as needs_review
from ({corpus}) where regexp_full_match(path, '.*MS-SQL-Server-Script.*[.]sql')
"""
    }
