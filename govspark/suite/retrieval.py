"""Vector search and the retrieval chain on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.operators import buckets, quota, retrieval, vector
from govspark.scratch import run_dir
from govspark.sources.tables import table
from govspark.suite.registry import query

CENTROIDS = """
cent AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (
  SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""
MEAN = """
cent AS (SELECT CAST(0 AS BIGINT) AS query_id, list(m ORDER BY pos) AS q FROM (
  SELECT pos, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos))"""


def hits_sql(centroids: str = CENTROIDS, k: int = 10, where: str = "TRUE", name: str = "hits") -> str:
    return f"""{centroids},
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT query_id, vec_id, label, ROUND(1 - pow(list_distance(embedding::DOUBLE[], q), 2), 6) AS score FROM embeddings, cent WHERE {where})
  QUALIFY rank <= {k})"""


K = 10


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def mean_query(spark, sf):
    return vector.centroids(vectors(spark, sf).withColumn("all", F.lit(0)), "all")


def hits(spark, sf, k=K, where=None):
    """The k nearest vectors of the mean vector of each label."""
    v = vectors(spark, sf)
    return vector.topk(v, vector.centroids(v, "label"), k, where)


def labelled(spark, sf, found):
    return retrieval.with_payload(found, vectors(spark, sf).select("vec_id", "label"))


PAYLOAD_SQL = """
payload AS (SELECT doc_id AS vec_id, text AS content, source AS title, CASE WHEN lang = 'en' THEN 'https://example.org/' || source ELSE '' END AS url,
            lang AS source FROM documents),
found AS (SELECT query_id, vec_id, score, rank, content, title, url, source FROM hits JOIN payload USING (vec_id))"""


def found(spark, sf):
    payload = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.col("source").alias("title"),
        F.when(F.col("lang") == "en", F.concat(F.lit("https://example.org/"), "source")).otherwise("").alias("url"),
        F.col("lang").alias("source"),
    )
    return retrieval.with_payload(hits(spark, sf), payload)


@query("vector_topk", f"WITH {hits_sql(MEAN, 10)} SELECT query_id, vec_id, score, rank FROM hits")
def vector_topk(spark, sf):
    return vector.topk(vectors(spark, sf), mean_query(spark, sf), 10)


@query("vector_topk_filtered", f"WITH {hits_sql(MEAN, 10, 'label = 3')} SELECT query_id, vec_id, score, rank FROM hits")
def vector_topk_filtered(spark, sf):
    return vector.topk(vectors(spark, sf), mean_query(spark, sf), 10, F.col("label") == 3)


@query("vector_topk_batch", f"WITH {hits_sql(k=5)} SELECT query_id, vec_id, score, rank FROM hits")
def vector_topk_batch(spark, sf):
    return hits(spark, sf, 5)


@query("vector_lsh")
def vector_lsh(spark, sf):
    """The k nearest of every vector whose id is divisible by 50, and what share of them an exact search confirms."""
    path = run_dir(spark, "buckets")
    buckets.write_bucketed(vectors(spark, sf), path)
    asked = vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = buckets.approx_topk(spark, path, asked, K)
    return found.join(buckets.recall(found, vector.topk(vectors(spark, sf), asked, K)), "query_id")


@query("rerank_flagged", f"""
WITH {hits_sql()}, flagged AS (SELECT *, label <= 2 AS flag, max(score) OVER (PARTITION BY query_id) AS best FROM hits),
near AS (SELECT *, bool_or(flag AND ROUND(best - score, 6) <= 0.05) OVER (PARTITION BY query_id) AS any_near FROM flagged)
SELECT query_id, vec_id, label, score, rank FROM near WHERE NOT any_near OR (flag AND ROUND(best - score, 6) <= 0.05)""")
def rerank_flagged(spark, sf):
    return retrieval.rerank_flagged(labelled(spark, sf, hits(spark, sf)), F.col("label") <= 2)


@query("retrieval_confidence", f"""
WITH {hits_sql()} SELECT query_id, COUNT(*) AS chunks, round_even(least(avg(score) + least(COUNT(*) * 0.1::DOUBLE, 0.3::DOUBLE), 1.0::DOUBLE), 2) AS confidence
FROM hits GROUP BY query_id""")
def retrieval_confidence(spark, sf):
    return retrieval.confidence(hits(spark, sf))


COLLECTION_SQL = "sided AS (SELECT *, CASE WHEN label < 5 THEN 'static' ELSE 'dynamic' END AS collection FROM hits)"


@query("pick_collection", f"""
WITH {hits_sql()}, {COLLECTION_SQL},
best AS (SELECT query_id, COALESCE(max(score) FILTER (WHERE collection = 'static'), 0) >= COALESCE(max(score) FILTER (WHERE collection = 'dynamic'), 0) AS s
         FROM sided GROUP BY query_id)
SELECT query_id, vec_id, score, collection FROM sided JOIN best USING (query_id) WHERE collection = CASE WHEN s THEN 'static' ELSE 'dynamic' END""")
def pick_collection(spark, sf):
    side = F.when(F.col("label") < 5, "static").otherwise("dynamic")
    sided = labelled(spark, sf, hits(spark, sf)).withColumn("collection", side)
    return retrieval.pick_collection(sided).select("query_id", "vec_id", "score", "collection")


@query("merge_collections", f"""
WITH {hits_sql(where='label < 5', name='a')}, {hits_sql(where='label >= 5', name='b').replace(CENTROIDS + ',', '', 1)},
both_sides AS (SELECT query_id, vec_id, score, 'static' AS source FROM a UNION ALL SELECT query_id, vec_id, score, 'dynamic' FROM b)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM both_sides QUALIFY rank <= 10""")
def merge_collections(spark, sf):
    first = hits(spark, sf, where=F.col("label") < 5).withColumn("source", F.lit("static"))
    second = hits(spark, sf, where=F.col("label") >= 5).withColumn("source", F.lit("dynamic"))
    return retrieval.merge_collections(first, second, K)


@query("filter_min_score", f"""
WITH {hits_sql()}, {PAYLOAD_SQL}
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS source_rank,
       CASE WHEN title <> '' THEN title ELSE url END AS title, url, score
FROM found WHERE score >= 0.1 AND url <> '' QUALIFY source_rank <= 4""")
def filter_min_score(spark, sf):
    return retrieval.min_score_sources(found(spark, sf), 0.1)


@query("extract_sources", f"""
WITH {hits_sql()}, {PAYLOAD_SQL},
top AS (SELECT query_id, title, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM found QUALIFY n <= 3),
wide AS (SELECT *, max(url) FILTER (WHERE n = 1) OVER (PARTITION BY query_id) AS u1, max(url) FILTER (WHERE n = 2) OVER (PARTITION BY query_id) AS u2 FROM top),
kept AS (SELECT * FROM wide WHERE n = 1 OR (n = 2 AND (u2 = '' OR u2 <> u1))
  OR (n = 3 AND CASE WHEN u2 <> '' AND u2 = u1 THEN url = '' OR url <> u1 WHEN u1 <> '' OR u2 <> '' THEN FALSE ELSE url <> '' END))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS INTEGER) AS position, title, url, score FROM kept""")
def extract_sources(spark, sf):
    return retrieval.extract_sources(found(spark, sf))


def packed_sql(budget: int) -> str:
    return f"""
blocks AS (SELECT query_id, rank, '--- Document ' || rank || ' ---' || chr(10) || CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) ELSE '' END ||
  CASE WHEN url <> '' THEN 'URL: ' || url || chr(10) ELSE '' END || CASE WHEN source <> '' THEN 'Source: ' || source || chr(10) ELSE '' END ||
  chr(10) || 'Content:' || chr(10) || content || chr(10) || chr(10) AS block FROM found),
fit AS (SELECT *, SUM(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM blocks QUALIFY e <= {budget}),
packed AS (SELECT query_id, CAST(COUNT(*) AS INTEGER) AS chunks_used, string_agg(block, '' ORDER BY rank) AS context FROM fit GROUP BY query_id)"""


@query("pack_context", f"WITH {hits_sql()}, {PAYLOAD_SQL}, {packed_sql(8000)} SELECT query_id, chunks_used, context FROM packed")
def pack_context(spark, sf):
    return retrieval.pack_context(found(spark, sf), retrieval.ANSWER_CHARS)


@query("context_gate", f"""
WITH {hits_sql()}, {PAYLOAD_SQL}, {packed_sql(2000)},
best AS (SELECT query_id, COUNT(*) AS chunks, max(score) AS max_score FROM found GROUP BY query_id)
SELECT query_id, COALESCE(chunks, 0) AS chunks, COALESCE(max_score, 0) AS max_score, context IS NOT NULL AND max_score > 0.35 AS sufficient,
  CASE WHEN context IS NOT NULL AND max_score > 0.35 THEN NULL WHEN chunks IS NULL THEN 'No relevant chunks found'
       WHEN max_score <= 0.3 THEN 'Low similarity scores (max: ' || format('{{:.3f}}', max_score) || ' < 0.3)'
       WHEN context IS NULL THEN 'Retrieved chunks contain no usable content (similarity: ' || format('{{:.3f}}', max_score) || ')'
       ELSE 'Unknown context issue' END AS reason
FROM cent LEFT JOIN best USING (query_id) LEFT JOIN packed USING (query_id)""")
def context_gate(spark, sf):
    chunks = found(spark, sf)
    context = retrieval.pack_context(chunks, retrieval.SUMMARY_CHARS)
    return retrieval.context_gate(vector.centroids(vectors(spark, sf), "label"), chunks, context, 0.35, 0.3)


WINDOW_SQL = "time_bucket(INTERVAL 1 HOUR, ts)"


@query("quota_batch", f"""
SELECT event_id, user_id, ts, {WINDOW_SQL} AS window_start, row_number() OVER w AS used, row_number() OVER w <= 2 AS allowed,
       greatest(0, 2 - row_number() OVER w) AS remaining
FROM events WINDOW w AS (PARTITION BY user_id, {WINDOW_SQL} ORDER BY ts, event_id)""")
def quota_batch(spark, sf):
    return quota.quota_batch(table(spark, sf, "events"), 2)


@query("quota_windows", f"""
SELECT user_id, {WINDOW_SQL} AS window_start, COUNT(*) AS requests, least(COUNT(*), 2) AS allowed, COUNT(*) - least(COUNT(*), 2) AS refused,
       2 - least(COUNT(*), 2) AS remaining FROM events GROUP BY 1, 2""")
def quota_windows(spark, sf):
    return quota.quota_windows(table(spark, sf, "events"), 2)


@query("quota_stats", f"""
WITH latest AS (SELECT time_bucket(INTERVAL 1 DAY, max(ts)) AS w FROM events),
used AS (SELECT user_id, least(COUNT(*) FILTER (WHERE time_bucket(INTERVAL 1 DAY, ts) = w), 2) AS n FROM events, latest GROUP BY user_id)
SELECT user_id AS client_id, 2 AS max_requests, n AS used_requests, 2 - n AS remaining_requests, 86400 AS time_window_seconds FROM used""")
def quota_stats(spark, sf):
    return quota.quota_stats(table(spark, sf, "events"), 2, 86400)


@query("quota_summary", f"""
WITH decided AS (SELECT *, row_number() OVER (PARTITION BY user_id, {WINDOW_SQL} ORDER BY ts, event_id) <= 2 AS allowed FROM events)
SELECT COUNT(*) AS requests, COUNT(*) FILTER (WHERE allowed) AS successful, COUNT(*) FILTER (WHERE NOT allowed) AS rate_limited,
  CAST(ROUND(SUM(CAST(value AS DECIMAL(18,6))) FILTER (WHERE allowed) / COUNT(*) FILTER (WHERE allowed), 4) AS DOUBLE) AS average_time,
  min(event_id) FILTER (WHERE NOT allowed) AS first_limited FROM decided""")
def quota_summary(spark, sf):
    return quota.quota_summary(quota.quota_batch(table(spark, sf, "events"), 2, keep=["value"]), "value")
