"""Run registered queries against their DuckDB counterparts and compare whole results."""

from __future__ import annotations

import datetime
import math
import pathlib
import sys
import time

import duckdb

TESTDATA = pathlib.Path("/root/testdata")


def oracle_connection(folder: str):
    connection = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(connection, name, frame, sql):
    """Return a list of differences; empty means the results agree row by row."""
    columns, rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return [] if rows else [f"{name}: no rows"]
    answer = connection.execute(sql)
    expected_columns, expected = _rows([d[0] for d in answer.description], answer.fetchall())
    problems = []
    if columns != expected_columns:
        problems.append(f"{name}: columns {columns} vs {expected_columns}")
    elif rows != expected:
        here, there = set(rows) - set(expected), set(expected) - set(rows)
        problems.append(f"{name}: {len(rows)} vs {len(expected)} rows {columns}\n  spark {sorted(here)[:3]}\n  sql   {sorted(there)[:3]}")
    if not rows:
        problems.append(f"{name}: no rows")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tallyframe.session import local_session

    folder = sys.argv[1] if sys.argv[1].startswith("/") else str(TESTDATA / sys.argv[1])
    wanted = sys.argv[2:]
    spark = local_session()
    connection = oracle_connection(folder)
    sqls, failures, count = entry.oracle_sql(), 0, 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        count += 1
        began = time.time()
        try:
            problems = compare(connection, name, query(spark, folder), sqls.get(name))
        except Exception as error:  # noqa: BLE001
            problems = [f"{name}: {type(error).__name__} {str(error)[:600]}"]
        spent = time.time() - began
        if problems:
            failures += 1
            print("FAIL", *problems, flush=True)
        elif spent > 2:
            print(f"slow {name} {spent:.1f}s", flush=True)
    print(f"{count - failures}/{count} ok")
