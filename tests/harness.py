"""Spark-vs-DuckDB comparison used by the tests and by check_oracle.py.

Comparison is strict: same column names, same row count, and the same
multiset of rows with exact values (floats compared bit for bit).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~null",)
        return ("f", v.hex())
    if isinstance(v, decimal.Decimal):
        return ("f", float(v).hex())
    if isinstance(v, bool):
        return ("i", int(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, _dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, _dt.date):
        return ("d", v.isoformat())
    return ("s", str(v))


def canon(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def spark_canon(df):
    rows = [tuple(r) for r in df.collect()]
    return canon(df.columns, rows)


def duck_canon(con, sql: str):
    rel = con.sql(sql)
    cols = rel.columns
    rows = rel.fetchall()
    return canon(cols, rows)


def compare(spark_df, con, sql: str, show: int = 5) -> tuple[bool, str]:
    s_cols, s_rows = spark_canon(spark_df)
    d_cols, d_rows = duck_canon(con, sql)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    if len(s_rows) != len(d_rows):
        msg = f"row count spark={len(s_rows)} duck={len(d_rows)}"
    elif s_rows == d_rows:
        return True, f"{len(s_rows)} rows equal"
    else:
        msg = f"values differ ({len(s_rows)} rows)"
    s_set, d_set = set(s_rows), set(d_rows)
    only_s = [r for r in s_rows if r not in d_set][:show]
    only_d = [r for r in d_rows if r not in s_set][:show]
    return False, f"{msg}; cols={s_cols}\n only spark: {only_s}\n only duck: {only_d}"
