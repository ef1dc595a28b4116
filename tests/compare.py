"""Runs a named query in Spark and its SQL twin in DuckDB and compares the rows as multisets."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    return {"int": "int", "float": "float"}.get(type(value).__name__, type(value).__name__)


def spark_rows(df):
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    return columns, Counter(rows)


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    index = [names.index(c) for c in columns]
    rows = [tuple(plain(r[i]) for i in index) for r in cursor.fetchall()]
    return columns, Counter(rows)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    left_columns, left = spark_rows(df)
    right_columns, right = oracle_rows(con, sql)
    if left_columns != right_columns:
        return f"columns {left_columns} vs {right_columns}"
    if left != right:
        only_spark, only_oracle = left - right, right - left
        return (
            f"rows {sum(left.values())} vs {sum(right.values())}; only spark {sum(only_spark.values())}: "
            f"{str(list(only_spark)[:2])[:600]}; only oracle: {str(list(only_oracle)[:2])[:600]}"
        )
    return None
