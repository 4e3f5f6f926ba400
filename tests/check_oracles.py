"""Run every query against its SQL: ``python tests/check_oracles.py [folder] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from rasterloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def differences(spark, connection, folder: str, name: str) -> str | None:
    """None when the query and its SQL agree, else the first difference."""
    frame = entry.queries()[name](spark, folder)
    got = _sorted_rows(frame.columns, frame.collect())
    answer = connection.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    expected = _sorted_rows(columns, answer.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for mine, theirs in zip(got, expected, strict=True):
        if mine != theirs:
            return f"{mine!r} against {theirs!r}"
        if [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"types of {mine!r} against {theirs!r}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = differences(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        verdict = "ok" if problem is None else f"FAILED {problem[:900]}"
        print(f"{name} {time.time() - started:.1f}s {verdict}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
