"""Streams over the test tables, run until all landed files are used."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.scratch import run_dir
from govspark.sources.tables import table
from govspark.streaming import incremental, quota
from govspark.streaming.sink import run_to_table
from govspark.suite.registry import query

LIMIT = 2


def empty_folder(spark):
    """A folder with a table of no rows, where the closing row will land."""
    path = run_dir(spark, "end")
    spark.createDataFrame([], quota.REQUESTS).coalesce(1).write.parquet(path)
    return path


@query("quota_stream", f"""
WITH counted AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, COUNT(*) AS requests FROM events GROUP BY 1, 2)
SELECT user_id, window_start, requests, least(requests, {LIMIT}) AS allowed, requests - least(requests, {LIMIT}) AS refused,
       {LIMIT} - least(requests, {LIMIT}) AS remaining
FROM counted""")
def quota_stream(spark, sf):
    last = empty_folder(spark)
    stream = quota.quota_stream(quota.request_stream(spark, sf, "events.parquet", end=last), LIMIT)
    closed = run_to_table(stream, "quota-stream", lambda: quota.end_requests(spark, last))
    return closed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("quota_stateful", f"""
WITH RECURSIVE seconds AS (SELECT user_id, date_trunc('second', ts) AS second, COUNT(*) AS requests FROM events GROUP BY 1, 2),
closed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY second) AS i FROM seconds),
walk AS (SELECT user_id, second, requests, i, second AS opened, CAST(0 AS BIGINT) AS before FROM closed WHERE i = 1
  UNION ALL SELECT c.user_id, c.second, c.requests, c.i,
    CASE WHEN c.second >= w.opened + INTERVAL 1 HOUR THEN c.second ELSE w.opened END,
    CASE WHEN c.second >= w.opened + INTERVAL 1 HOUR THEN 0 ELSE w.before + w.requests END
  FROM walk w JOIN closed c ON c.user_id = w.user_id AND c.i = w.i + 1)
SELECT user_id, second, requests, least(requests, greatest(0, {LIMIT} - before)) AS allowed, greatest(0, {LIMIT} - before - requests) AS remaining FROM walk""")
def quota_stateful(spark, sf):
    last = empty_folder(spark)
    stream = quota.anchored_quota(quota.request_stream(spark, sf, "events.parquet", end=last), LIMIT)
    with quota.rocksdb(spark):
        decided = run_to_table(stream, "quota-stateful", lambda: quota.end_requests(spark, last))
    return decided.withColumn("second", F.col("second").cast("timestamp_ntz"))


ITEM = "event_id bigint, user_id bigint, event_type string, value double"


@query("incremental_load", "SELECT event_id, user_id, event_type, value FROM events")
def incremental_load(spark, sf):
    landing = run_dir(spark, "landing")
    items = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    # Everything lands twice, as after a repeated pull.
    for _ in range(2):
        items.repartition(4, "event_id").write.mode("append").json(landing)
    target, checkpoint = run_dir(spark, "target"), run_dir(spark, "checkpoint")
    return incremental.incremental_load(spark, landing, target, checkpoint, ITEM, "event_id", files_per_batch=3)
