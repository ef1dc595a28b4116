from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from govspark.sources import layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write(spark, tmp_path, df, key, buckets=4, **how):
    name, path = f"t_{uuid.uuid4().hex}", str(tmp_path / uuid.uuid4().hex)
    layout.write_bucketed(df, name, path, key, buckets, **how)
    return name, path


def test_joins_without_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    many = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    one = spark.range(650).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    (m, path), (o, _) = write(spark, tmp_path, many, "k"), write(spark, tmp_path, one, "k")
    for how in ("inner", "left"):
        joined = layout.bucketed_join(spark, m, path, o, "k", how)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert sorted(joined.collect(), key=str) == sorted(many.join(one, "k", how).collect(), key=str)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_lie_apart(spark, tmp_path):
    many = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("v"))
    one = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    (m, path), (o, _) = write(spark, tmp_path, many, "k", group_rows=500), write(spark, tmp_path, one, "k")
    assert {r.k for r in spark.read.parquet(f"{path}/hot").select("k").distinct().collect()} == {7}
    assert spark.table(m).where("k = 7").count() == 0
    for how in ("inner", "left"):
        joined = layout.bucketed_join(spark, m, path, o, "k", how)
        assert "hashpartitioning(k" not in plan(joined).split("BroadcastExchange")[0]
        assert sorted(joined.collect(), key=str) == sorted(many.join(one, "k", how).collect(), key=str)


def test_few_files_for_each_filter(spark, tmp_path):
    path = str(tmp_path / "z")
    df = spark.range(20_000).select(
        F.element_at(F.array(*map(F.lit, ["asia", "europe", "africa", "america"])), (F.col("id") % 4 + 1).cast("int")).alias("network"),
        F.when(F.col("id") % 97 == 0, None).otherwise((F.col("id") / 4 % 8).cast("int")).alias("kind"), (F.col("id") / 32 % 3).cast("int").alias("status"), F.col("id").alias("n"),
    )
    layout.write_clustered(df, path, ["network", "kind", "status"], "n", file_rows=250)
    files = spark.read.parquet(f"{path}/files").count()
    assert files >= 60
    for where, test in (
        ({"network": ["asia"]}, "network = 'asia'"),
        ({"kind": [3]}, "kind = 3"),
        ({"status": [1]}, "status = 1"),
        ({"kind": [None, 2], "network": ["africa"]}, "(kind IS NULL OR kind = 2) AND network = 'africa'"),
        ({"n": [5, 6], "status": [0]}, "n IN (5, 6) AND status = 0"),
        ({"network": ["nowhere"]}, "false"),
    ):
        found = layout.read_clustered(spark, path, where)
        assert sorted(found.collect(), key=str) == sorted(df.where(test).collect(), key=str)
        share = df.where(test).count() / 20_000
        opened = len(found.inputFiles())
        if "n" not in where:
            assert opened <= files * min(1, 3 * share + 0.06)


def test_equal_keys_fill_several_files(spark, tmp_path):
    df = spark.range(5000).select(F.lit("x").alias("network"), F.col("id").alias("n"))
    layout.write_clustered(df, str(tmp_path / "z"), ["network"], "n", file_rows=500)
    assert spark.read.parquet(str(tmp_path / "z" / "files")).count() >= 8
    empty = df.limit(0)
    layout.write_clustered(empty, str(tmp_path / "e"), ["network"], "n")
    assert layout.read_clustered(spark, str(tmp_path / "e"), {"network": ["x"]}).count() == 0
