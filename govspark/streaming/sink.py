"""Running a stream over everything that has landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from govspark.scratch import run_dir


def run_to_table(stream: DataFrame, name: str, end: Callable[[], None] | None = None) -> DataFrame:
    """Appends the stream to a Parquet folder until the landed input is used up; the folder as a table.

    ``end`` lands whatever closes the stream's open windows; the same query then goes on until that is used up too.
    """
    spark = stream.sparkSession
    target, checkpoint = run_dir(spark, name), run_dir(spark, f"{name}-checkpoint")

    def run() -> None:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", target)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    if end is not None:
        end()
        run()
    return spark.read.schema(stream.schema).parquet(target)
