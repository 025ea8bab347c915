"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, folder):
    """(message or None, rows, seconds of Spark, seconds of DuckDB)"""
    began = time.time()
    df = run(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_time = time.time() - began
    if sql is None:
        return None, len(ours[1]), spark_time, 0.0
    began = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    sql_time = time.time() - began
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", len(ours[1]), spark_time, sql_time
    if ours[1] != theirs[1]:
        mine, other = set(ours[1]), set(theirs[1])
        columns = [c for i, c in enumerate(ours[0])
                   if sorted(r[i] for r in ours[1]) != sorted(r[i] for r in theirs[1])]
        short = [[tuple(x[:60] for x in r) for r in sorted(part)[:2]] for part in (mine - other, other - mine)]
        note = (f"{len(ours[1])} rows vs {len(theirs[1])}, {len(mine - other)} differ; columns {columns}; "
                f"only ours {short[0]}; only SQL {short[1]}")
        return note[:2500], len(ours[1]), spark_time, sql_time
    return None, len(ours[1]), spark_time, sql_time
