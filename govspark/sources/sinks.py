"""Table, CSV, JSON and vector sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.operators.ordered import positions
from govspark.sources.scans import CSV

ENVELOPE_ITEMS = 1000


def load_table(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes Parquet and compares the counts before and after, as one row.

    The rows written are counted by the write itself (an observation), so the input is not read again for it.
    """
    from pyspark.sql import Observation

    spark, written = df.sparkSession, Observation()
    before = spark.read.parquet(path).count() if mode == "append" else 0
    df.observe(written, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    expected = written.get["n"] + before
    return (
        spark.read.parquet(path)
        .agg(F.count(F.lit(1)).alias("rows_after"))
        .withColumn("rows_before", F.lit(expected))
        .withColumn("complete", F.col("rows_after") == F.col("rows_before"))
    )


def load_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    """Batched inserts into a database table."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def write_key_list(df: DataFrame, path: str, columns: list[str], fmt: str = "json") -> None:
    """The keys of new rows, with their dates."""
    df.select(*columns).write.mode("overwrite").option("header", fmt == "csv").format(fmt).save(path)


def envelopes(items: DataFrame, network: str, order: list[str], size: int = ENVELOPE_ITEMS) -> DataFrame:
    """Rows packed into records {network, timestamp, total_items, items[]} of at most ``size`` items."""
    numbered = positions(items, [network], order, "_n")
    batch = F.floor((F.col("_n") - 1) / size)
    item = F.struct(*order, *[c for c in items.columns if c != network and c not in order])
    packed = numbered.groupBy(F.col(network).alias("network"), batch.alias("batch")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return packed.select(
        "network", F.current_timestamp().cast("string").alias("timestamp"), F.size("items").alias("total_items"), "items"
    )


def write_envelopes(items: DataFrame, path: str, network: str, order: list[str], size: int = ENVELOPE_ITEMS) -> None:
    """One envelope per line; the files of a folder hold one network."""
    packed = envelopes(items, network, order, size).withColumn("file_network", F.col("network"))
    packed.write.mode("overwrite").partitionBy("file_network").json(path)


def write_vectors(chunks: DataFrame, path: str) -> None:
    """Vector collections: a stable id per chunk; a collection is replaced whole, the others stay."""
    keyed = chunks.withColumn("chunk_id", F.sha2(F.concat_ws(":", "collection", "doc_id", "chunk_index"), 256))
    sized = keyed.hint("rebalance", "collection")
    sized.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Layout for filters on ``by``. Rebalancing gives each value files of even size: rare values share no task with
    others, frequent ones are split over several tasks."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
