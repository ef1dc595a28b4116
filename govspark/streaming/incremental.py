"""Incremental load of new records from landed files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.operators.joins import new_records_of_small_batch

LOAD, BATCH, BUCKET = "_load", "_batch", "_bucket"
#: Parts of a target by hash of the key, unless it was started for more rows; a batch reads only those its keys fall into.
BUCKETS, MOST_BUCKETS = 64, 4096
#: Rows of a part that are aimed at.
BUCKET_ROWS = 5_000_000


def load_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the load that a checkpoint stands for; kept beside its progress, so a new checkpoint is a new load."""
    path = f"{checkpoint}/load_id"
    try:
        return spark.read.text(path).first()["value"]
    except AnalysisException:
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
        return spark.read.text(path).first()["value"]


def _table_schema(schema: T.StructType) -> T.StructType:
    parts = [T.StructField(LOAD, T.StringType()), T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
    return T.StructType([*schema.fields, *parts])


def buckets_for(rows: int) -> int:
    """Parts of a target that will hold about so many rows."""
    return min(MOST_BUCKETS, max(BUCKETS, -(-rows // BUCKET_ROWS)))


def bucket_count(spark: SparkSession, target: str, wanted: int = BUCKETS) -> int:
    """How many parts the target is cut into: fixed when it is started, whatever is wanted later."""
    path = f"{target}/_buckets"
    try:
        return int(spark.read.text(path).first()["value"])
    except AnalysisException:
        count = BUCKETS if _started(spark, target) else wanted
        spark.createDataFrame([(str(count),)], "value string").coalesce(1).write.text(path)
        return count


def _started(spark: SparkSession, target: str) -> bool:
    """Whether a target is there already; one without a note of its parts has BUCKETS."""
    try:
        spark.read.schema(f"{LOAD} string").parquet(target)
        return True
    except AnalysisException:
        return False


def append_new(batch: DataFrame, batch_id: int, target: str, key: str, load: str = "load") -> None:
    """Writes the batch's unseen keys as one partition of the target, by load and batch.

    Each batch owns its partition and compares itself with all others, so a batch that is run again after a failure
    writes the same rows to the same place, and batches of another load are never overwritten.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(bucket_count(spark, target))).cast("int")
    fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn(BUCKET, bucket).persist()
    touched = [r[BUCKET] for r in fresh.select(BUCKET).distinct().collect()]  # MOST_BUCKETS rows at most
    known = spark.read.schema(_table_schema(batch.schema)).parquet(target).where(F.col(BUCKET).isin(touched))
    known = known.where((F.col(LOAD) != load) | (F.col(BATCH) != batch_id))
    new = new_records_of_small_batch(fresh, known, key)
    new.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/{LOAD}={load}/{BATCH}={batch_id}")
    fresh.unpersist()


def start_table(empty: DataFrame, target: str, load: str) -> None:
    """An empty partition, so that the target can be read before its first batch."""
    empty.coalesce(1).write.mode("overwrite").parquet(f"{target}/{LOAD}={load}/{BATCH}=-1/{BUCKET}=-1")


def incremental_load(
    spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str, key: str, files_per_batch: int = 1000,
    expected_rows: int = 0,
) -> DataFrame:
    """Loads all files that have landed since the last run and returns the target table.

    ``expected_rows`` says how large the target may grow; its first load fixes the number of parts by it. Partitions of the target are named by the load that the checkpoint stands for and its batches. A load under another
    checkpoint adds to the same target.
    """
    empty = spark.createDataFrame([], schema)
    load = load_id(spark, checkpoint)
    bucket_count(spark, target, buckets_for(expected_rows))
    start_table(empty, target, load)
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)
    run = (
        landed.writeStream.foreachBatch(lambda batch, batch_id: append_new(batch, batch_id, target, key, load))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(_table_schema(empty.schema)).parquet(target).drop(LOAD, BATCH, BUCKET)
