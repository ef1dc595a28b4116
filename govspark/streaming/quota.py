"""Quotas over a stream of requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from govspark.operators.quota import MAX_REQUESTS, WINDOW_SECONDS, with_admission

REQUESTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: A moment after all requests.
END_OF_TIME = dt.datetime(2999, 1, 1)


def end_requests(spark: SparkSession, folder: str) -> None:
    """Lands one row without a user after all others, which closes every window that is still open."""
    end = spark.createDataFrame([(None, END_OF_TIME, None, None, None, None)], REQUESTS)
    end.coalesce(1).write.mode("append").parquet(folder)


def request_stream(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 100, end: str | None = None
) -> DataFrame:
    """Requests from landed files, with the event time as an instant.

    ``end`` is a folder that stays empty while requests come in; ``end_requests`` lands the closing row there.
    """
    stream = (
        spark.readStream.schema(REQUESTS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    if end is not None:
        stream = stream.unionByName(spark.readStream.schema(REQUESTS).parquet(end))
    return stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


def quota_stream(requests: DataFrame, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Epoch-aligned windows: requests, admitted and refused per user and window, once the window has closed.

    Counts are pre-aggregated in every task, and state holds one count per user and open window. A request that
    arrives again within the delay counts once.
    """
    once = requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    counted = counted.where(F.col("user_id").isNotNull())
    return with_admission(counted.select("user_id", F.col("w.start").alias("window_start"), "requests"), limit)


ANCHORED = "user_id bigint, second bigint, requests bigint, allowed bigint, remaining bigint"


class AnchoredWindow(StatefulProcessor):
    """Per user: second in which the window opened and requests seen in it."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, used bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        out = []
        batch = pd.concat(list(rows)).sort_values("second")
        for second, n in zip(batch["second"].tolist(), batch["requests"].tolist()):
            if opened is None or second >= opened + self.seconds:
                opened, used = second, 0
            allowed = min(n, max(0, self.limit - used))
            used += n
            out.append((key[0], second, n, allowed, max(0, self.limit - used)))
        self.window.update((opened, used))
        self.handle.registerTimer((opened + self.seconds) * 1000)
        yield pd.DataFrame(out, columns=["user_id", "second", "requests", "allowed", "remaining"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and (self.window.get()[0] + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def anchored_quota(requests: DataFrame, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Windows that open at a user's first request and close ``seconds`` later.

    Requests are first counted per user and second, so that a busy user reaches the stateful step as at most one row
    per second. State is the window start and the number used; a timer drops it once the window has passed. Needs the
    RocksDB state store.
    """
    per_second = (
        requests.withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", "1 second").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("user_id", F.unix_seconds("w.start").alias("second"), "requests")
    )
    decided = per_second.groupBy("user_id").transformWithStateInPandas(
        AnchoredWindow(limit, seconds), ANCHORED, "append", "eventTime"
    )
    return decided.where(F.col("user_id").isNotNull()).withColumn("second", F.timestamp_seconds("second"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for the streams started inside; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)
