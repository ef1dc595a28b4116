"""Tables laid out for what is asked of them: joins without a shuffle, filters that open few files.

*Buckets.* Two tables cut by the same key into as many buckets join bucket by bucket. A key of very many rows would make its
bucket one long task, so its rows, found on a sample, lie apart and are joined to the few rows of the other side they need.

*Clusters.* Rows are sorted by a key that interleaves the bits of several columns' ranks, so that files are narrow in each of
these columns. The least and greatest values of every file lie beside them; a filter picks files by these before Spark
opens one. Equal keys are spread over files by a further column.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators.joins import BROADCAST_KEYS
from govspark.operators.ordered import WINDOW_ROWS, hot_groups

#: Bits of a column's rank in a cluster key, rows that the ranks are taken from, rows of a file.
RANK_BITS, RANKED_ROWS, FILE_ROWS = 6, 100_000, 1_000_000


def buckets_for(rows: int, file_rows: int = FILE_ROWS) -> int:
    """A power of two, so that tables of different sizes still share their buckets."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows / file_rows))))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, group_rows: int = WINDOW_ROWS) -> None:
    """A table of the catalogue in ``buckets`` files by hash of the key, each sorted by it.

    Rows of hot keys, at most as many keys as the rows divided by ``group_rows``, go to files of even size beside it.
    """
    hot = hot_groups(df.where(F.col(key).isNotNull()), [key], group_rows).select(key)
    few = 0 < hot.count() <= BROADCAST_KEYS
    cold = df.join(F.broadcast(hot), key, "left_anti").select(*df.columns) if few else df
    cold.repartition(buckets, F.col(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/buckets").saveAsTable(name)
    apart = df.join(F.broadcast(hot), key, "left_semi").select(*df.columns) if few else df.limit(0)
    apart.write.mode("overwrite").parquet(f"{path}/hot")


def bucketed_join(spark: SparkSession, many: str, many_path: str, one: str, key: str, how: str = "inner") -> DataFrame:
    """Rows of the bucketed table ``many`` with those of ``one``, whose key is unique; inner or left.

    Both are bucketed by the key into the same number, so neither is shuffled; hot rows meet the few rows of ``one`` that
    they need.
    """
    right = spark.table(one)
    cold = spark.table(many)
    hot = spark.read.schema(cold.schema).parquet(f"{many_path}/hot")
    joined = cold.hint("merge").join(right, key, how)
    keys = hot.select(key).distinct()
    if not keys.limit(1).count():
        return joined
    needed = right.join(F.broadcast(keys), key, "left_semi")
    return joined.unionByName(hot.join(F.broadcast(needed), key, how))


def split_values(df: DataFrame, column: str, bits: int = RANK_BITS) -> list:
    """At most 2^bits - 1 values that cut the column into parts of about equal size, from a bounded number of rows."""
    present = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    share = min(1.0, RANKED_ROWS / max(1, present.count()))
    some = (present.sample(share, seed=5) if share < 1 else present).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
    total, parts, out, upto = sum(r.n for r in some), 1 << bits, [], 0
    if len(some) <= parts:
        return [r.v for r in some[1:]]
    for r in some:
        if upto >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(r.v)
        upto += r.n
    return out


def cluster_key(columns: dict[str, list], bits: int = RANK_BITS) -> Column:
    """The interleaved bits of the columns' ranks among their split values, the first column's highest; nulls rank lowest."""
    def ranked(name: str, cuts: list) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.coalesce(cut <= F.col(name), F.lit(False)))) if cuts else F.lit(0)

    key = F.lit(0).cast("bigint")
    n = len(columns)
    for i, (name, cuts) in enumerate(columns.items()):
        rank = ranked(name, cuts)
        for bit in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * n + n - 1 - i))
    return key


def write_clustered(df: DataFrame, path: str, by: list[str], tie: str, file_rows: int = FILE_ROWS, bits: int = RANK_BITS) -> None:
    """Files sorted by the cluster key of ``by``; ``tie`` is a column of many values, which cuts equal keys."""
    key = cluster_key({c: split_values(df, c, bits) for c in by}, bits)
    files = max(1, -(-df.count() // file_rows))
    placed = df.withColumn("_cluster", key).repartitionByRange(files, "_cluster", tie).sortWithinPartitions("_cluster", tie)
    placed.drop("_cluster").write.mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in by for f in (F.min, F.max)]
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls_{c}") for c in by]
    stored.groupBy(F.input_file_name().alias("file")).agg(*ends, *nulls).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def read_clustered(spark: SparkSession, path: str, where: dict[str, list]) -> DataFrame:
    """Rows whose columns are among the given values, from the files that may hold such rows.

    Null among the values stands for missing ones. Columns that the table is not clustered by filter rows only.
    """
    from pyspark.sql import types as T

    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()["value"]))
    files = spark.read.parquet(f"{path}/files")
    rows = spark.read.schema(schema)
    kept, test = files, F.lit(True)
    for name, values in where.items():
        present = [v for v in values if v is not None]
        mine = F.col(name).isin(present)
        if len(present) < len(values):
            mine = mine | F.col(name).isNull()
        test = test & F.coalesce(mine, F.lit(False))
        if f"min_{name}" in files.columns:
            inside = F.lit(False)
            for v in present:
                inside = inside | F.coalesce(F.lit(v).between(F.col(f"min_{name}"), F.col(f"max_{name}")), F.lit(False))
            if len(present) < len(values):
                inside = inside | (F.col(f"nulls_{name}") > 0)
            kept = kept.where(inside)
    picked = [r.file for r in kept.select("file").collect()]
    if not picked:
        return spark.createDataFrame([], schema)
    return rows.parquet(*picked).where(test)
