"""Compare registered queries with their SQL, run by DuckDB on the same tables.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def compare(columns, rows, sql_columns, sql_rows) -> str:
    if sorted(columns) != sorted(sql_columns):
        return f"columns differ: {sorted(columns)} / {sorted(sql_columns)}"
    if len(rows) != len(sql_rows):
        return f"row counts differ: {len(rows)} / {len(sql_rows)}"
    order, sql_order = sorted(columns), sorted(sql_columns)
    at = [columns.index(c) for c in order]
    sql_at = [sql_columns.index(c) for c in sql_order]
    mine = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_key)
    other = sorted((tuple(_plain(r[i]) for i in sql_at) for r in sql_rows), key=_key)
    bad = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ in {order}, first {bad[0]}"
    kinds = [
        (c, type(a).__name__, type(b).__name__)
        for a_row, b_row in zip(mine, other, strict=True)
        for c, a, b in zip(order, a_row, b_row, strict=True)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    return f"types differ: {kinds[0]}" if kinds else ""


def check(spark, folder: str, name: str, fn, sql: str | None) -> tuple[str, int, float]:
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return "", len(rows), seconds
    con = connect(folder)
    result = con.execute(sql)
    sql_columns = [c[0] for c in result.description]
    return compare(df.columns, rows, sql_columns, result.fetchall()), len(rows), seconds


if __name__ == "__main__":
    from breathline.catalog import all_queries, all_sql
    from breathline.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    sqls, failed = all_sql(), []
    for name, fn in all_queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            problem, n, seconds = check(session, folder, name, fn, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem, n, seconds = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0
        state = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{state:5} {name:32} rows={n:<7} {seconds:6.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    session.stop()
    sys.exit(bool(failed))
