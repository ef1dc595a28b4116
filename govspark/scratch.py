"""Working folders that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a cluster a missing setting is
    an error, because a folder of one machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="govspark-")
        context.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of one job."""
    return f"{shared_dir(spark)}/govspark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """The result of ``df`` as a table in the shared folder.

    It is computed once however often it is read, survives lost executors, and has a known size, by which Spark decides
    whether to broadcast it.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
