"""Top-k with the number of all matching rows, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators.joins import BROADCAST_KEYS


def count_rows(rows: DataFrame) -> Column:
    """Row count as a scalar subquery; Spark reads only the filter columns for it."""
    return rows.agg(F.count(F.lit(1))).scalar()


def topk_with_total(rows: DataFrame, order: Sequence[Column], k: int = 10, counted: DataFrame | None = None) -> DataFrame:
    """The first ``k`` rows plus ``total_count``.

    Each task keeps its k best rows and counts its own, so k rows and one number per task move; the literal
    ``count(*) OVER ()`` would move every match into one task. An aggregate under both shares its shuffle; of a join the
    count reads the keys only. ``counted`` replaces ``rows`` under the count where both have the same number of rows but
    ``counted`` is narrower.
    """
    return rows.orderBy(*order).limit(k).withColumn("total_count", count_rows(rows if counted is None else counted))


#: Rows of a top-k report that are fetched to look up their keys by value.
REPORT_ROWS = 1000


def lookup_for_few(few: DataFrame, many: DataFrame, key: str, k: int) -> DataFrame:
    """Left join of a report of at most ``k`` rows to a large table that has ``key`` unique.

    A usual report is fetched, so that it is computed once and its keys become a filter which the scan of the large
    table can skip row groups by. A longer one stays distributed: its keys are broadcast to that scan. Either way the
    large table is not shuffled.
    """
    if k <= REPORT_ROWS:
        rows = few.collect()
        few = few.sparkSession.createDataFrame(rows, few.schema)
        keys = sorted({r[key] for r in rows} - {None})
        return few.join(many.where(F.col(key).isin(keys)), key, "left")
    wanted = few.select(key).where(F.col(key).isNotNull()).distinct()
    return few.join(many.join(F.broadcast(wanted) if k <= BROADCAST_KEYS else wanted, key, "left_semi"), key, "left")
