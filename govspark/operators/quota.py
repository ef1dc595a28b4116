"""Request quotas per user over a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators.ordered import positions

# Requests per window and its length.
MAX_REQUESTS, WINDOW_SECONDS = 20, 3600


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned window."""
    return F.window(ts, f"{seconds} seconds")["start"]


def quota_batch(
    requests: DataFrame, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, keep: Sequence[str] = ()
) -> DataFrame:
    """Every request with its number in the user's window, whether it is allowed and what remains after it."""
    windowed = requests.select("event_id", "user_id", "ts", *keep, window_start(F.col("ts"), seconds).alias("window_start"))
    numbered = positions(windowed, ["user_id", "window_start"], ["ts", "event_id"], "used")
    return numbered.withColumn("allowed", F.col("used") <= limit).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used"))
    )


def quota_windows(requests: DataFrame, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Requests, admitted and refused ones per user and window."""
    counted = requests.groupBy("user_id", window_start(F.col("ts"), seconds).alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return with_admission(counted, limit)


def with_admission(counted: DataFrame, limit: int) -> DataFrame:
    admitted = F.least(F.col("requests"), F.lit(limit))
    return counted.withColumns({"allowed": admitted, "refused": F.col("requests") - admitted, "remaining": F.lit(limit) - admitted})


def quota_stats(requests: DataFrame, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Use of the latest window by every user; a user without request in it has used nothing."""
    latest = requests.agg(F.max("ts").alias("ts")).select(window_start(F.col("ts"), seconds)).scalar()
    in_window = window_start(F.col("ts"), seconds) == latest
    counted = requests.groupBy("user_id").agg(F.count(F.when(in_window, 1)).alias("n"))
    used = F.least(F.col("n"), F.lit(limit))
    return counted.select(
        F.col("user_id").alias("client_id"),
        F.lit(limit).alias("max_requests"),
        used.alias("used_requests"),
        (F.lit(limit) - used).alias("remaining_requests"),
        F.lit(seconds).alias("time_window_seconds"),
    )


def quota_summary(decided: DataFrame, time: str) -> DataFrame:
    """Allowed and refused requests, mean time of the allowed, number of the first refused one, per window start."""
    allowed = F.col("allowed")
    return decided.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(allowed, 1)).alias("successful"),
        F.count(F.when(~allowed, 1)).alias("rate_limited"),
        F.round(F.avg(F.when(allowed, F.col(time)).cast("decimal(18,6)")), 4).cast("double").alias("average_time"),
        F.min(F.when(~allowed, F.col("event_id"))).alias("first_limited"),
    )
