"""Exact distinct counts that add up: stored bitmaps of whole-number ids per month.

An id is one bit of one bitmap of 32,768; a month keeps a bitmap for each range of ids that occurs in it. Months are joined
by OR, so any span of months costs its bitmaps and not its rows, and a month that is loaded in several parts simply has
several bitmaps. Bits are set in every task before anything is shuffled, so a frequent id or a busy month is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Periods and how Spark names them.
PERIODS = {"month": "month", "quarter": "quarter", "year": "year"}


def month_bitmaps(rows: DataFrame, id: str, when: str, by: list[str] | None = None) -> DataFrame:
    """(by, month, range, bits) of the ids seen in each month; rows without an id or a time say nothing."""
    present = rows.where(F.col(id).isNotNull() & F.col(when).isNotNull())
    value = F.col(id).cast("bigint")
    placed = present.select(*(by or []), F.to_date(F.trunc(when, "month")).alias("month"), F.bitmap_bucket_number(value).alias("range"), F.bitmap_bit_position(value).alias("bit"))
    return placed.groupBy(*(by or []), "month", "range").agg(F.bitmap_construct_agg("bit").alias("bits"))


def store_month_bitmaps(rows: DataFrame, id: str, when: str, path: str, load: str, by: list[str] | None = None) -> None:
    """One load's bitmaps; the same load again replaces its own."""
    month_bitmaps(rows, id, when, by).write.mode("overwrite").parquet(f"{path}/load={load}")


def distinct_over(stored: DataFrame, period: Column, by: list[str] | None = None) -> DataFrame:
    """(by, period, distinct): exact numbers of ids over any grouping of months."""
    joined = stored.groupBy(*(by or []), period.alias("period"), "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    return joined.groupBy(*(by or []), "period").agg(F.sum(F.bitmap_count("bits")).alias("distinct"))


def distinct_by_period(spark: SparkSession, path: str, period: str) -> DataFrame:
    """(period, distinct) by month, quarter or year from all stored loads."""
    stored = spark.read.parquet(path).select("month", "range", "bits")
    return distinct_over(stored, F.to_date(F.date_trunc(PERIODS[period], "month")))


def distinct_between(spark: SparkSession, path: str, first: str, last: str) -> int:
    """Ids seen in the months from ``first`` to ``last``, both given by any of their days."""
    stored = spark.read.parquet(path).where(F.col("month").between(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date")))
    return distinct_over(stored, F.lit("all")).agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
