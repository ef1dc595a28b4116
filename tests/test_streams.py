"""Streams against their batch twins, over several batches and restarts."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from govspark.streaming import incremental, quota
from govspark.streaming.sink import run_to_table


def landed(spark, tmp_path, name, rows, files):
    """Rows in several files, in order of time."""
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    path = str(tmp_path / name)
    size = -(-len(rows) // files)
    for i in range(files):
        df.where(F.col("event_id").between(i * size, (i + 1) * size - 1)).coalesce(1).write.mode("append").parquet(path)
    return path


def requests(n, users, seed):
    rng = random.Random(seed)
    at, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=rng.randint(1, 120))
        rows.append((i, at, 0 if rng.random() < 0.4 else rng.randrange(users), "x", 1.0, "{}"))
    return rows


def test_anchored_quota_over_batches(spark, tmp_path):
    rows = requests(600, 5, 4)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", quota.ROCKSDB)
    stream = quota.request_stream(spark, landed(spark, tmp_path, "req", rows, 4), files_per_batch=1)
    got = run_to_table(quota.anchored_quota(stream, 3, 3600, "1 minute"), "anchored").collect()
    per_second: dict = {}
    for _, ts, user, *_ in rows:
        per_second[(user, ts)] = per_second.get((user, ts), 0) + 1
    state: dict = {}
    last = rows[-1][1] - dt.timedelta(minutes=1)
    expected = set()
    for (user, ts), n in sorted(per_second.items(), key=lambda x: x[0][1]):
        opened, used = state.get(user, (None, 0))
        if opened is None or ts >= opened + dt.timedelta(hours=1):
            opened, used = ts, 0
        if ts + dt.timedelta(seconds=1) <= last:
            expected.add((user, ts, n, min(n, max(0, 3 - used)), max(0, 3 - used - n)))
        state[user] = (opened, used + n)
    assert {(r["user_id"], r["second"], r["requests"], r["allowed"], r["remaining"]) for r in got} == expected


def test_window_quota_counts_repeats_once(spark, tmp_path):
    rows = requests(300, 4, 8)
    path = landed(spark, tmp_path, "req", rows, 3)
    spark.read.parquet(path).where("event_id < 50").coalesce(1).write.mode("append").parquet(path)
    stream = quota.request_stream(spark, path, files_per_batch=10)
    got = run_to_table(quota.quota_stream(stream, 5, 3600, "1 minute"), "windows").collect()
    counted: dict = {}
    for _, ts, user, *_ in rows:
        window = ts.replace(minute=0, second=0)
        counted[(user, window)] = counted.get((user, window), 0) + 1
    last = rows[-1][1] - dt.timedelta(minutes=1)
    expected = {(u, w, n, min(n, 5)) for (u, w), n in counted.items() if w + dt.timedelta(hours=1) <= last}
    assert {(r["user_id"], r["window_start"], r["requests"], r["allowed"]) for r in got} == expected


SCHEMA = "id bigint, v string"


def test_incremental_load_restarts(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "target", "checkpoint"))

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(landing)

    def load():
        table = incremental.incremental_load(spark, landing, target, checkpoint, SCHEMA, "id", files_per_batch=1)
        return sorted((r["id"], r["v"]) for r in table.collect())

    land([(1, "a"), (2, "b"), (2, "b"), (None, "x")])
    assert load() == [(1, "a"), (2, "b")]
    assert load() == [(1, "a"), (2, "b")]
    land([(2, "later"), (3, "c")])
    land([(3, "later"), (4, "d")])
    loaded = load()
    assert [i for i, _ in loaded] == [1, 2, 3, 4] and loaded[1] == (2, "b")


def test_replayed_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "target")
    incremental.start_table(spark.createDataFrame([], SCHEMA), target, "load")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    for _ in range(2):
        incremental.append_new(batch, 0, target, "id")
    assert spark.read.parquet(target).count() == 2


def test_loads_under_two_checkpoints_keep_all_rows(spark, tmp_path):
    target = str(tmp_path / "target")
    for name, ids in (("one", range(5)), ("two", range(3, 13))):
        landing = str(tmp_path / f"landing-{name}")
        spark.createDataFrame([(i, name) for i in ids], SCHEMA).coalesce(1).write.json(landing)
        table = incremental.incremental_load(spark, landing, target, str(tmp_path / f"checkpoint-{name}"), SCHEMA, "id")
    assert sorted((r["id"], r["v"]) for r in table.collect()) == [(i, "one" if i < 5 else "two") for i in range(13)]


def test_parts_follow_the_expected_size_and_stay(spark, tmp_path):
    assert [incremental.buckets_for(n) for n in (0, 10**8, 2 * 10**9, 10**12)] == [64, 64, 400, 4096]
    landing, target = str(tmp_path / "landing"), str(tmp_path / "target")
    for i, rows in enumerate((10**9, 0)):
        spark.range(i * 20, i * 20 + 30).selectExpr("id", "'x' AS v").write.mode("append").json(landing)
        table = incremental.incremental_load(spark, landing, target, str(tmp_path / "check"), "id long, v string", "id", expected_rows=rows)
    assert table.count() == 50 and incremental.bucket_count(spark, target) == 200
    old = str(tmp_path / "old")
    incremental.start_table(spark.createDataFrame([], "id long"), old, "load")
    assert incremental.bucket_count(spark, old, 4096) == 64
