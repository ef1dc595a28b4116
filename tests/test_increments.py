from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from govspark.functions import predicates  # noqa: F401
from govspark.operators import bitmaps, chunk, profile, sketches
from govspark.operators.vector import hash_embeddings
from govspark.plans import voting
from govspark.sources import quarantine
from govspark.streaming import standings


def test_bitmaps_add_up(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, -5, 0, 7, 32768, 10**12, rng.randrange(500)]), dt.datetime(2023, 1, 1) + dt.timedelta(days=rng.randrange(700))) for _ in range(3000)] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, at timestamp")
    path = str(tmp_path / "b")
    for _ in range(2):  # a load that is run again replaces itself
        bitmaps.store_month_bitmaps(df.where("id % 2 = 0"), "id", "at", path, "even")
    bitmaps.store_month_bitmaps(df.where("id % 2 <> 0"), "id", "at", path, "odd")
    for period in bitmaps.PERIODS:
        expected = df.where("id IS NOT NULL AND at IS NOT NULL").groupBy(F.to_date(F.date_trunc(period, "at"))).agg(F.countDistinct("id"))
        assert sorted(map(tuple, bitmaps.distinct_by_period(spark, path, period).collect())) == sorted(map(tuple, expected.collect()))
    some = {i for i, at in rows if i is not None and at and dt.datetime(2023, 3, 1) <= at < dt.datetime(2024, 2, 1)}
    assert bitmaps.distinct_between(spark, path, "2023-03-15", "2024-01-31") == len(some)
    assert bitmaps.distinct_between(spark, path, "2030-01-01", "2031-01-01") == 0
    by = bitmaps.distinct_over(bitmaps.month_bitmaps(df.withColumn("g", F.col("id") % 3), "id", "at", ["g"]), F.lit("all"), ["g"])
    assert {r.g: r["distinct"] for r in by.collect()} == {g: len({i for i, at in rows if i is not None and at and (i % 3 if i >= 0 else -((-i) % 3)) == g}) for g in {r.g for r in by.collect()}}


def test_merged_sketches_are_near_exact(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.col("id").alias("n"), (F.col("id") % 700).cast("string").alias("s"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("x"), F.lit(None).cast("int").alias("empty"),
        (F.col("id") / 1000).cast("int").alias("file"),
    )
    path = str(tmp_path / "s")
    data = rows.drop("file")
    for name, part in (("a", "file < 10"), ("b", "file >= 10"), ("b", "file >= 10")):
        mine = rows.where(part)
        sketches.add_files(mine, F.col("file"), path, name)
    found = {r.column_name: r for r in sketches.merged_profile(spark, path).collect()}
    assert found["n"].rows == 30_000 and found["n"].files == 30 and found["x"].null_count == 6000
    for c in data.columns:
        exact = data.select(F.countDistinct(c)).first()[0]
        assert abs(found[c]["distinct"] - exact) <= 3 * 1.04 / 64 * exact
    assert float(found["n"].least) == 0 and float(found["n"].greatest) == 29_999 and found["s"].greatest == "99"
    assert abs(found["n"].q50 - 15_000) < 0.02 * 30_000 and abs(found["x"].q25 - 3_750) < 0.02 * 15_000 and found["s"].q50 is None
    one_pass = {r.column_name: r for r in profile.profile_columns_approx(data).collect()}
    assert all(found[c]["distinct"] == one_pass[c].unique_count for c in ("s",))
    exact = {c: data.select(F.countDistinct(c)).first()[0] for c in data.columns}
    assert all(abs(one_pass[c].unique_count - exact[c]) <= 0.05 * exact[c] for c in exact)


def test_standings_after_every_load(spark, tmp_path):
    rng = random.Random(2)
    votes = [(rng.choice([1, 1, 1, None, rng.randrange(40)]), rng.randrange(60), i % 4) for i in range(800)]
    power = [(i, rng.choice([None, float("nan"), float(rng.randrange(9000)) / 8])) for i in range(50)] + [(50, 1e300)]
    v, p = spark.createDataFrame(votes, "voter long, parent_vote_id long, load int"), spark.createDataFrame(power, "id long, self_voting_power double")
    store = str(tmp_path / "s")
    for i in range(4):
        for _ in range(1 + i % 2):
            standings.add_load(v.where(F.col("load") == i), p, store, f"l{i}")
        if i in (1, 2):
            standings.fold(spark, store)
        expected = voting.top_voters(v.where(F.col("load") <= i), p, 100)
        assert standings.top_voters(spark, store, 100).collect() == expected.collect()


def test_quarantine_loses_nothing(spark, tmp_path):
    item = "struct<id:bigint,title:string,deep:struct<a:int>>"
    good = [{"id": 1, "title": "a"}, {"id": None, "more": 1}, {}, {"deep": {"a": 3}}]
    bad = [5, "x", None, [1], {"id": "n/a"}, {"deep": "flat"}]
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"network": "n", "items": good + bad}), "{broken", json.dumps({"network": "n", "items": []}), json.dumps({"network": "m"}), json.dumps([1]), "", "  "]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"network": "k", "items": good}))
    got = quarantine.load_checked(spark, str(tmp_path / "in"), item, str(tmp_path / "out"))
    assert got.counts == {"read": 17, "good": 8, "rejected": 9}
    assert {(r.file.rsplit("/", 1)[1], r.good, r.rejected) for r in got.by_file().collect()} == {("a.json", 4, 9), ("b.json", 4, 0)}
    reasons = [(r.reason, r.text) for r in got.rejected.collect()]
    assert sorted(x for x, _ in reasons) == ["no envelope"] * 3 + ["no object"] * 4 + ["wrong type"] * 2
    assert ("no envelope", "{broken") in reasons and ("wrong type", '{"id":"n/a"}') in reasons
    assert sorted(map(str, got.good.where("network = 'k'").select("id", "title", "deep").collect())) == sorted(
        map(str, got.good.where("network = 'n'").select("id", "title", "deep").collect())
    )
    assert got.good.where("deep.a = 3").count() == 2


@pytest.mark.parametrize("dim", [16, 256])
def test_hash_embeddings_count_words(spark, dim):
    df = spark.createDataFrame([(1, "a b a C"), (2, "c A a b"), (3, "?!"), (4, "b")], "doc_id long, content string")
    found = {r.doc_id: list(r.embedding) for r in hash_embeddings(df, dim).collect()}
    assert found[1] == found[2] and found[3] == [0.0] * dim and sum(x > 0 for x in found[4]) == 1
    assert abs(sum(x * x for x in found[1]) - 1) < 1e-6 and max(found[1]) >= 2 / 6**0.5 - 1e-6


def test_overlapping_chunks_of_dense_texts():
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    chunks = list(chunk.split_text(text, 1000, 200))
    assert chunks == [text[i : i + 4000] for i in range(0, 6401, 3200)]
