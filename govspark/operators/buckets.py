"""Approximate nearest neighbours: vectors stored by the side they lie on of some planes, searched bucket by bucket.

Opt-in, for tables too large to scan per question. The number of planes follows the number of vectors, so that a bucket keeps
its size as the table grows. Queries are joined to the buckets they probe; a frequent bucket, of vectors or of queries, is
cut into blocks of bounded bytes, and every pair of blocks is one group. Any number of queries can be asked at once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators import vector
from govspark.scratch import settle

SEED = 17
#: Vectors of a bucket that are aimed at, and planes at least and at most: at most 65,536 buckets, whose numbers and sizes travel.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 2000, 4, 16
#: Buckets that a query probes.
PROBES = 16


def planes(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, bits))


def bits_for(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))


def write_bucketed(vectors: DataFrame, path: str, bits: int | None = None) -> None:
    """Vectors (vec_id, embedding) in one partition per bucket, and the size of every bucket beside them."""
    present = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull())
    bits = bits or bits_for(present.count())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = vector._matrix(batch.column("embedding"))
                codes = (points @ planes(points.shape[1], bits) > 0) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("embedding"), pa.array(codes, pa.int32())], ["vec_id", "embedding", "bucket"]
                )

    coded = present.mapInArrow(code, "vec_id bigint, embedding array<float>, bucket int")
    coded.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    spark = vectors.sparkSession
    spark.createDataFrame([(json.dumps({"bits": bits}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bits")
    stored = spark.read.schema("vec_id bigint, embedding array<float>, bucket int").parquet(f"{path}/rows")
    stored.groupBy("bucket").agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def probed_buckets(queries: np.ndarray, probes: int, bits: int) -> np.ndarray:
    """Per query its own bucket and those across the planes it lies nearest to, nearest first.

    The best sets of crossed planes are grown plane by plane from the nearest one on: of all sets only the ``probes`` cheapest are kept.
    """
    side = queries @ planes(queries.shape[1], bits)
    own = (side > 0) @ (1 << np.arange(bits))
    order = np.argsort(np.abs(side), axis=1)
    sets, cost = np.zeros((len(queries), 1), np.int64), np.zeros((len(queries), 1))
    for i in range(bits):
        plane = order[:, i : i + 1]
        sets = np.concatenate([sets, sets | (1 << plane)], 1)
        cost = np.concatenate([cost, cost + np.abs(np.take_along_axis(side, plane, 1))], 1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        sets, cost = np.take_along_axis(sets, best, 1), np.take_along_axis(cost, best, 1)
    return own[:, None] ^ sets


def _probes(queries: DataFrame, probes: int, bits: int) -> DataFrame:
    """(query_id, embedding, bucket): a row per query and bucket it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = probed_buckets(vector._matrix(batch.column("embedding")), probes, bits)
                rows = np.repeat(np.arange(batch.num_rows), found.shape[1])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found.ravel(), pa.int32())], ["query_id", "embedding", "bucket"])

    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.where(F.col("embedding").isNotNull()).mapInArrow(run, "query_id bigint, embedding array<double>, bucket int")


def approx_topk(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = PROBES, block_bytes: int = vector.BLOCK_BYTES) -> DataFrame:
    """The k nearest vectors in the probed buckets; queries for which these hold fewer than k are searched exactly."""
    bits = json.loads(spark.read.text(f"{path}/bits").first()["value"])["bits"]
    stored = spark.read.schema("vec_id bigint, embedding array<float>, bucket int").parquet(f"{path}/rows")
    asked = settle(_probes(queries, probes, bits), "probes")
    # at most 2^bits rows: the buckets that are probed, and how many blocks each side of them is cut into
    dim = asked.agg(F.max(F.size("embedding"))).first()[0] or 1
    block_rows = max(1, block_bytes // (8 * dim))
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("bigint")
    sizes = asked.groupBy("bucket").agg(F.count("*").alias("asked")).join(spark.read.parquet(f"{path}/sizes"), "bucket")
    cuts = settle(sizes.select("bucket", blocks("rows").alias("vn"), blocks("asked").alias("qn")), "probed-buckets")
    wanted = [r.bucket for r in cuts.select("bucket").collect()]

    def dealt(rows: DataFrame, key: str, own: str, n: str, other: str, m: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1))
        return rows.join(F.broadcast(cuts), "bucket").withColumn(own, F.pmod(F.xxhash64(key), F.col(n))).withColumn(other, every).drop("vn", "qn")

    left = dealt(stored.where(F.col("bucket").isin(wanted)), "vec_id", "vb", "vn", "qb", "qn")
    right = dealt(asked, "query_id", "qb", "qn", "vb", "vn")
    by = ["bucket", "vb", "qb"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(vector.block_hits(k), "query_id bigint, vec_id bigint, score double")
    near = settle(vector._rank(hits, k), "near")
    full = near.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = settle(queries.join(full, "query_id", "left_anti"), "short")
    exact = vector.topk(stored.drop("bucket"), short, k)
    return near.join(full, "query_id", "left_semi").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's exact neighbours that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
