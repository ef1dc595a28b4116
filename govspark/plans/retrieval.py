"""Search over several collections and everything an answer needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators import retrieval as r
from govspark.operators import vector
from govspark.scratch import settle


def search_collections(collections: dict[str, DataFrame], queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """The k best hits of every query over all collections; ``source`` names the collection of a hit."""
    found = [vector.topk(v, queries, k, where).withColumn("source", F.lit(name)) for name, v in collections.items()]
    return reduce(lambda a, b: r.merge_collections(a, b, k), found)


def answer_inputs(
    queries: DataFrame, hits: DataFrame, flag: Column, budget: int = r.ANSWER_CHARS, threshold: float = r.GATE_SCORE, bar: float = r.GATE_SCORE
) -> DataFrame:
    """One row per query: context, whether it is enough and why not, and the confidence.

    ``hits`` carry title, url, source and content. Flagged hits near the best replace the others first.
    """
    kept = settle(r.rerank_flagged(hits, flag), "kept-hits")
    context = settle(r.pack_context(kept, budget), "contexts")
    gate = r.context_gate(queries, kept, context, threshold, bar)
    confidence = r.confidence(kept).select("query_id", "confidence")
    return (
        gate.join(confidence, "query_id", "left")
        .join(context, "query_id", "left")
        .select(
            "query_id", "chunks", "max_score", "sufficient", "reason",
            F.when(F.col("sufficient"), F.col("confidence")).otherwise(0.0).alias("confidence"),
            F.when(F.col("sufficient"), F.col("context")).alias("context"),
        )
    )
