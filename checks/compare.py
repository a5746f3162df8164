"""Run registered queries against their SQL twins: python -m checks.compare [sf] [name...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import all_sql
from checks.queries import all_queries

TESTDATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _sorted(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda row: [(value is None, str(value)) for value in row],
    )


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """What differs between a query and its twin, None when they agree."""
    frame = all_queries()[name](spark, sf_dir)
    mine = _sorted(frame.collect(), frame.columns)
    sql = all_sql().get(name)
    if sql is None:
        return None
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    theirs = _sorted(cursor.fetchall(), names)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for left, right in zip(mine, theirs):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            return f"{left}\n   / {right}"
    return None if mine else "no rows"


def main(argv: list[str]) -> int:
    from scriptloom.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = str(TESTDATA / f"sf{sf}")
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(master="local[8]", shuffle_partitions=8, **quiet)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in argv[1:] or all_queries():
        start = time.time()
        try:
            found = difference(spark, con, name, sf_dir)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        mark = "ok " if found is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {found or ''}")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
