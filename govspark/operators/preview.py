"""Short views of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.functions.text import result_line

# Parts of the names of the columns that matter most in a result.
KEY_COLUMN_PARTS = ["title", "index", "status", "network", "type", "createdat", "amount"]
SINGLE_ROWS, MULTI_ROWS, MAX_KEY_COLUMNS = 10, 5, 10


def key_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(part in c.lower() for part in KEY_COLUMN_PARTS)][:MAX_KEY_COLUMNS]


def result_preview(rows: DataFrame, order: list[Column], k: int = SINGLE_ROWS, limit: int = 2000) -> DataFrame:
    """The first k rows as numbered lines."""
    first = rows.orderBy(*order).limit(k).withColumn("_n", F.row_number().over(W.orderBy(*order)))
    line = F.concat(F.lit("#"), F.col("_n").cast("string"), F.lit(": "), result_line(rows.columns, limit))
    return first.select(F.col("_n").alias("row_number"), line.alias("line"))
