"""Nearest neighbours by exact search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors that one task may hold, as 8-byte numbers; more are searched block against block.
MAX_QUERY_BYTES = 32 * 1024 * 1024
#: Vectors, as 8-byte numbers, of one side of a block.
BLOCK_BYTES = 64 * 1024 * 1024
#: Scores held at once while vectors meet queries.
SCORE_CELLS = 2_000_000
SCORE_DIGITS = 6


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """1 - squared distance for every (vector, query), rounded so that equal vectors tie."""
    squared = (vectors**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2.0 * vectors @ queries.T
    return np.round(1.0 - squared, SCORE_DIGITS)


def _columns(vectors: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, scores of all vectors) one query after another, computed in tiles of at most about SCORE_CELLS numbers."""
    step = max(1, SCORE_CELLS // max(1, len(vectors)))
    for first in range(0, len(queries), step):
        tile = _scores(vectors, queries[first : first + step])
        for q in range(tile.shape[1]):
            yield first + q, tile[:, q]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Index of the k best, by score and then by id."""
    if len(scores) > k:
        bar = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_few(vectors: DataFrame, query_ids: list, queries: np.ndarray, k: int) -> DataFrame:
    """Every task scans its vectors once against all queries and hands on k hits per query."""
    id_type = dict(vectors.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0, dtype=np.int64), np.empty(0)) for _ in query_ids]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for q, scores in _columns(_matrix(batch.column("embedding")), queries):
                best = _best(ids, scores, k)
                all_ids = np.concatenate([kept[q][0], ids[best]])
                all_scores = np.concatenate([kept[q][1], scores[best]])
                top = _best(all_ids, all_scores, k)
                kept[q] = (all_ids[top], all_scores[top])
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array([q for q, (i, _) in zip(query_ids, kept) for _ in i], pa.int64()),
                "vec_id": pa.array(np.concatenate([i for i, _ in kept]), pa.int64()),
                "score": pa.array(np.concatenate([s for _, s in kept]), pa.float64()),
            }
        )

    present = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull())
    return _rank(present.mapInArrow(run, f"query_id bigint, vec_id {id_type}, score double"), k)


def block_hits(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For a block of vectors and one of queries: k hits of every query."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids = left["vec_id"].to_numpy()
            query_ids = right["query_id"].to_numpy()
            for q, scores in _columns(np.stack(left["embedding"]).astype(np.float64), np.stack(right["embedding"]).astype(np.float64)):
                best = _best(ids, scores, k)
                out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def _search_blocks(vectors: DataFrame, queries: DataFrame, k: int, vector_blocks: int, query_blocks: int) -> DataFrame:
    """Blocks of vectors against blocks of queries: each pair of blocks is one bounded group."""

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = vectors.where(F.col("embedding").isNotNull()).select(
        "vec_id", "embedding", block("vec_id", vector_blocks).alias("vb"), every(query_blocks).alias("qb")
    )
    right = queries.select(
        "query_id", "embedding", block("query_id", query_blocks).alias("qb"), every(vector_blocks).alias("vb")
    )
    hits = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(
        block_hits(k), "query_id bigint, vec_id bigint, score double"
    )
    return _rank(hits, k)


def rows_of_block(dim: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, dim)))


def topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    where: Column | None = None,
    max_query_bytes: int = MAX_QUERY_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest vectors of every query: query_id, vec_id, score, rank.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding. A metadata filter goes to the scan. A
    small query table, judged by its size, travels with the task; a larger one is searched in blocks.
    """
    searched = vectors if where is None else vectors.where(where)
    searched = searched.withColumn("vec_id", F.col("vec_id").cast("bigint"))
    queries = queries.withColumn("query_id", F.col("query_id").cast("bigint"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not size["n"]:
        return searched.select(
            F.lit(None).cast("bigint").alias("query_id"), "vec_id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank")
        ).where(F.lit(False))
    if size["n"] * size["dim"] * 8 <= max_query_bytes:
        rows = queries.select("query_id", "embedding").orderBy("query_id").collect()
        return _search_few(searched, [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), k)
    block_rows = block_rows or rows_of_block(size["dim"])
    vector_blocks = math.ceil(searched.count() / block_rows) or 1
    query_blocks = math.ceil(size["n"] / block_rows)
    return _search_blocks(searched, queries, k, vector_blocks, query_blocks)


def query_vector(spark, query_id: int, vector: Sequence[float]) -> DataFrame:
    """One query as a query table."""
    return spark.createDataFrame([(query_id, [float(x) for x in vector])], "query_id bigint, embedding array<double>")


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group. Summed per (group, dimension), so a large group is pre-aggregated in every task."""
    parts = vectors.select(by, F.posexplode("embedding")).groupBy(by, "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
    gathered = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("dims"))
    return gathered.select(F.col(by).cast("bigint").alias("query_id"), F.col("dims.mean").alias("embedding"))


def collection_stats(vectors: DataFrame, source: str) -> DataFrame:
    """Chunks per source beside the number of all chunks."""
    counted = vectors.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("chunks"))
    return counted.withColumn("total_chunks", vectors.agg(F.count(F.lit(1))).scalar())


def hash_embeddings(chunks: DataFrame, dim: int = 256, content: str = "content") -> DataFrame:
    """Deterministic word-hash vectors of unit length, inside the JVM; a text without words gets the zero vector."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = chunks.withColumn("_words", F.filter(F.split(F.lower(content), r"\W+"), lambda w: w != ""))
    counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(words)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def embed(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], content: str = "content", batch: int = 100) -> DataFrame:
    """Vectors from any encoder of text batches, ``batch`` texts per call."""

    @F.pandas_udf("array<float>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            parts = [encode(series.iloc[i : i + batch].tolist()) for i in range(0, len(series), batch)]
            yield pd.Series(list(np.concatenate(parts))) if parts else pd.Series([], dtype=object)

    return chunks.withColumn("embedding", vectors(content))
