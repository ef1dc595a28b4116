"""From hits to an answer context. ``hits`` has query_id, vec_id, score, rank and what the step needs beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.scratch import settle

# Closeness to the best score for flagged hits, context and summary lengths, score bars, source counts.
FLAG_MARGIN = 0.05
CONTEXT_CHARS, ANSWER_CHARS, SUMMARY_CHARS = 4000, 8000, 2000
GATE_SCORE, MIN_SOURCE_SCORE = 0.6, 0.7
MAX_WEB_SOURCES, SOURCE_CANDIDATES, WANTED_SOURCES = 4, 3, 2
CHUNK_BONUS, MAX_BONUS = 0.1, 0.3

def with_payload(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunk.

    The hits are settled first: the search runs once, and the size of the hits decides whether they travel to the scan
    of the chunks or both sides are shuffled.
    """
    return chunks.join(settle(hits, "hits"), "vec_id")


def best_per_query() -> W:
    return W.partitionBy("query_id")


def rerank_flagged(hits: DataFrame, flag: Column) -> DataFrame:
    """Only the flagged hits near the best score, for queries that have such; all hits for the others."""
    best = hits.groupBy("query_id").agg(
        F.max("score").alias("_best"), F.max(F.when(flag, F.col("score"))).alias("_best_flagged")
    )
    joined = hits.join(best, "query_id")
    near = F.round(F.col("_best") - F.col("score"), 6) <= FLAG_MARGIN
    any_near = F.coalesce(F.round(F.col("_best") - F.col("_best_flagged"), 6) <= FLAG_MARGIN, F.lit(False))
    return joined.where(~any_near | (flag & near)).drop("_best", "_best_flagged")


def confidence(hits: DataFrame) -> DataFrame:
    """Mean score with a bonus for more hits, at most 1."""
    grouped = hits.groupBy("query_id").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("chunks"))
    bonus = F.least(F.col("chunks") * CHUNK_BONUS, F.lit(MAX_BONUS))
    return grouped.select("query_id", "chunks", F.bround(F.least(F.col("mean") + bonus, F.lit(1.0)), 2).alias("confidence"))


def pick_collection(hits: DataFrame, collection: str = "collection", preferred: str = "static", other: str = "dynamic") -> DataFrame:
    """The hits of the collection with the better best score; ties go to ``preferred``."""
    best = hits.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col(collection) == preferred, F.col("score"))), F.lit(0.0)).alias("_preferred"),
        F.coalesce(F.max(F.when(F.col(collection) == other, F.col("score"))), F.lit(0.0)).alias("_other"),
    )
    chosen = F.when(F.col("_preferred") >= F.col("_other"), preferred).otherwise(other)
    joined = hits.join(best.select("query_id", chosen.alias("_chosen")), "query_id")
    return joined.where(F.col(collection) == F.col("_chosen")).drop("_chosen")


def merge_collections(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Hits of two collections in one ranking, cut to k per query."""
    order = best_per_query().orderBy(F.col("score").desc(), F.col("vec_id").asc())
    both = first.drop("rank").unionByName(second.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_score_sources(hits: DataFrame, least: float = MIN_SOURCE_SCORE) -> DataFrame:
    """Sources with a link and a score of at least ``least``, the best four per query; a link stands in for a title."""
    order = best_per_query().orderBy(F.col("score").desc(), F.col("vec_id").asc())
    kept = hits.where((F.col("score") >= least) & (F.col("url") != ""))
    ranked = kept.withColumn("source_rank", F.row_number().over(order)).where(F.col("source_rank") <= MAX_WEB_SOURCES)
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    return ranked.select("query_id", "source_rank", title.alias("title"), "url", "score")


def extract_sources(hits: DataFrame) -> DataFrame:
    """Sources to cite, from the three best hits: each link once, hits without link only while fewer than two are
    listed, and no more after two of which one has a link."""
    order = best_per_query().orderBy(F.col("score").desc(), F.col("vec_id").asc())
    top = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SOURCE_CANDIDATES)
    source = F.struct("_n", F.coalesce("title", F.lit("Unknown Title")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), "score")
    grouped = top.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("candidates"))

    def add(listed: Column, candidate: Column) -> Column:
        done = (F.size(listed) >= WANTED_SOURCES) & F.exists(listed, lambda s: s["url"] != "")
        new_link = (candidate["url"] != "") & ~F.exists(listed, lambda s: s["url"] == candidate["url"])
        spare = (candidate["url"] == "") & (F.size(listed) < WANTED_SOURCES)
        return F.when(~done & (new_link | spare), F.array_append(listed, candidate)).otherwise(listed)

    nothing = F.slice("candidates", 1, 0)
    chosen = grouped.select("query_id", F.posexplode(F.aggregate("candidates", nothing, add)))
    return chosen.select("query_id", F.col("pos").alias("position"), "col.title", "col.url", "col.score")


def context_blocks(hits: DataFrame) -> DataFrame:
    """The text of each hit as a numbered document with its title, link and source."""
    def line(label: str, column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(column), F.lit("\n"))).otherwise("")

    block = F.concat(
        F.lit("--- Document "), F.col("rank").cast("string"), F.lit(" ---\n"),
        line("Title", "title"), line("URL", "url"), line("Source", "source"),
        F.lit("\nContent:\n"), F.col("content"), F.lit("\n\n"),
    )
    return hits.withColumn("block", block)


def pack_context(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Documents in rank order until the next one would exceed the budget.

    Lengths are positive, so the rule is a filter on the running length; the window holds the k hits of one query.
    """
    before = best_per_query().orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    blocks = context_blocks(hits).withColumn("_end", F.sum(F.length("block")).over(before)).where(F.col("_end") <= budget)
    grouped = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["block"]), "")
    return grouped.select("query_id", F.size("rows").alias("chunks_used"), text.alias("context"))


def context_gate(queries: DataFrame, hits: DataFrame, contexts: DataFrame, threshold: float = GATE_SCORE, bar: float = GATE_SCORE) -> DataFrame:
    """Whether a query has enough context, and why not."""
    best = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("max_score"))
    has_text = F.coalesce(F.trim(F.col("context")) != "", F.lit(False))
    joined = queries.select("query_id").join(best, "query_id", "left").join(contexts.select("query_id", "context"), "query_id", "left")
    chunks, top = F.coalesce("chunks", F.lit(0)), F.coalesce("max_score", F.lit(0.0))
    enough = has_text & (chunks > 0) & (top > threshold)
    shown = F.format_string("%.3f", top)
    reason = (
        F.when(enough, None)
        .when(chunks == 0, "No relevant chunks found")
        .when(top <= bar, F.concat(F.lit("Low similarity scores (max: "), shown, F.lit(f" < {bar})")))
        .when(~has_text, F.concat(F.lit("Retrieved chunks contain no usable content (similarity: "), shown, F.lit(")")))
        .otherwise("Unknown context issue")
    )
    return joined.select("query_id", chunks.alias("chunks"), top.alias("max_score"), enough.alias("sufficient"), reason.alias("reason"))
