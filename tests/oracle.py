"""Runs named queries on Spark and their SQL on DuckDB and compares all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, fn, sql, folder):
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{sorted(names)}: got {a} want {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tillworks.session import build_session

    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in entry.oracle_sql():
                problem = compare(spark, con, name, fn, entry.oracle_sql()[name], folder)
            else:
                problem = None
                n = fn(spark, folder).count()
                print(f"     {name}: {n} rows, no SQL", end=" ")
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
