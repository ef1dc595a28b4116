"""Even work for row-wise operators over few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_scan(scan: DataFrame) -> DataFrame:
    """A scan with at least one task per core.

    Files that cannot be split, such as Parquet with one row group, give a scan fewer tasks than the cluster has cores,
    and an operator with much work per row then runs on a few of them. Only such a scan is repartitioned; a large table
    has more splits than cores and stays as it is. For plain scans: counting the splits runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
