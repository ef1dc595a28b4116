"""Profiles and statistics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.operators import profile as pr
from govspark.operators import union
from govspark.operators.spread import spread_scan
from govspark.sources.tables import proposals, table
from govspark.suite.registry import query

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
PAIRS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in ORDER_COLUMNS)
TYPES = """CASE column_name WHEN 'o_orderkey' THEN 'bigint' WHEN 'o_custkey' THEN 'bigint' WHEN 'o_totalprice' THEN 'double'
  WHEN 'o_orderdate' THEN 'timestamp_ntz' ELSE 'string' END"""
ROLES = """CASE WHEN regexp_matches(lower(column_name), 'id|hash|address|proposer|beneficiary') THEN 'key'
  WHEN regexp_matches(lower(column_name), 'created_at|updated_at|timestamp|date|time') THEN 'date'
  WHEN regexp_matches(lower(column_name), 'amount|reward|balance|value|count|index') THEN 'numeric'
  WHEN regexp_matches(lower(column_name), 'status|state|phase') THEN 'status'
  WHEN regexp_matches(lower(column_name), 'title|content|description|name') THEN 'content' ELSE 'other' END"""


@query("value_counts", "SELECT o_orderpriority AS value, COUNT(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return pr.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query("profile_columns", f"""
WITH pairs AS ({PAIRS}),
stats AS (SELECT column_name, COUNT(value) AS non_null_count, COUNT(*) - COUNT(value) AS null_count,
                 COUNT(DISTINCT value) AS unique_count FROM pairs GROUP BY 1),
ranked AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS r
           FROM (SELECT DISTINCT column_name, value FROM pairs WHERE value IS NOT NULL)),
samples AS (SELECT column_name, string_agg(value, ' | ' ORDER BY value) AS sample_values FROM ranked WHERE r <= 5 GROUP BY 1)
SELECT column_name, non_null_count, null_count, unique_count, sample_values, {TYPES} AS data_type, {ROLES} AS role
FROM stats LEFT JOIN samples USING (column_name)""")
def profile_columns(spark, sf):
    return pr.profile_columns(spread_scan(table(spark, sf, "orders")))


@query("profile_columns_approx", f"""
WITH pairs AS ({PAIRS})
SELECT column_name, COUNT(value) AS non_null_count, COUNT(*) - COUNT(value) AS null_count, TRUE AS near_exact FROM pairs GROUP BY 1""")
def profile_columns_approx(spark, sf):
    """Counts, and whether the estimate of distinct values is within a tenth of the exact number."""
    orders = spread_scan(table(spark, sf, "orders"))
    exact = orders.agg(*[F.countDistinct(c).alias(c) for c in orders.columns]).unpivot([], orders.columns, "column_name", "exact")
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.1 * F.col("exact")
    return pr.profile_columns_approx(orders).join(exact, "column_name").select("column_name", "non_null_count", "null_count", near.alias("near_exact"))


@query("profile_columns_estimates")
def profile_columns_estimates(spark, sf):
    """Counts, and the estimates of distinct values themselves; tests hold these against exact numbers."""
    return pr.profile_columns_approx(spread_scan(table(spark, sf, "orders")))


@query("column_roles", f"""
WITH names AS (SELECT unnest(json_keys(to_json(orders))) AS column_name FROM orders)
SELECT column_name, {ROLES} AS role, COUNT(*) AS records FROM names GROUP BY 1, 2""")
def column_roles(spark, sf):
    rows = spread_scan(table(spark, sf, "orders"))
    names = rows.select(F.explode(F.json_object_keys(F.to_json(F.struct("*")))).alias("column_name"))
    counted = names.groupBy("column_name").agg(F.count(F.lit(1)).alias("records"))
    return counted.withColumn("role", pr.role_column(F.col("column_name")))


@query("structure_profile", f"""
WITH pairs AS ({PAIRS})
SELECT column_name, {TYPES} AS data_type, COUNT(*) > COUNT(value) AS has_nulls,
       COUNT(*) = COUNT(value) AND COUNT(*) = COUNT(DISTINCT value) AS is_unique FROM pairs GROUP BY column_name""")
def structure_profile(spark, sf):
    return pr.structure_profile(spread_scan(table(spark, sf, "orders")))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
MERGED = f"""merged AS (
  SELECT {', '.join(CUSTOMER)}, {', '.join('NULL AS ' + c for c in SUPPLIER)}, NULL AS topic FROM customer
  UNION ALL SELECT {', '.join('NULL' for _ in CUSTOMER)}, {', '.join(SUPPLIER)}, NULL FROM supplier)"""


@query("null_profile", f"WITH {MERGED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT({c}) > 0 AS has_data FROM merged"
    for c in [*CUSTOMER, *SUPPLIER, "topic"]) + " ORDER BY 2 DESC, 1 LIMIT 10")
def null_profile(spark, sf):
    merged = union.union_merge_schema(
        table(spark, sf, "customer"), table(spark, sf, "supplier")
    ).withColumn("topic", F.lit(None).cast("string"))
    return pr.most_nulls(merged)


@query("date_ranges", """
SELECT 'l_shipdate' AS column_name, min(l_shipdate) AS earliest, max(l_shipdate) AS latest, COUNT(l_shipdate) AS total_dates
FROM lineitem""")
def date_ranges(spark, sf):
    return pr.date_ranges(table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag"), ["l_shipdate", "l_returnflag"])


@query("text_profile", """
SELECT doc_id, text AS sample, (SELECT ROUND(AVG(length(text)), 6) FROM documents) AS avg_length FROM documents
ORDER BY doc_id LIMIT 3""")
def text_profile(spark, sf):
    return pr.text_profile(table(spark, sf, "documents"), "text", "doc_id")


@query("column_overlap", """
WITH records AS (
  SELECT event_type, list_concat(json_keys(props),
    CASE WHEN event_type IN ('click', 'view', 'error') THEN ['user_id'] ELSE [] END,
    CASE WHEN event_type = 'purchase' THEN ['value'] ELSE [] END) AS names FROM events),
pairs AS (SELECT DISTINCT event_type, unnest(names) AS column_name FROM records)
SELECT column_name, COUNT(*) AS frequency, COUNT(*) > 0.5 * (SELECT COUNT(DISTINCT event_type) FROM events) AS is_common,
       COUNT(*) <= 3 AS is_rare, COUNT(*) = 1 AS is_unique FROM pairs GROUP BY column_name""")
def column_overlap(spark, sf):
    kind = F.col("event_type")
    nothing = F.array().cast("array<string>")
    names = F.concat(
        F.json_object_keys("props"),
        F.when(kind.isin("click", "view", "error"), F.array(F.lit("user_id"))).otherwise(nothing),
        F.when(kind == "purchase", F.array(F.lit("value"))).otherwise(nothing),
    )
    return pr.column_overlap(table(spark, sf, "events"), "event_type", names)


@query("file_inventory", """
SELECT COUNT(*) AS row_count, (SELECT CAST(COUNT(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS column_count, TRUE AS sized FROM lineitem""")
def file_inventory(spark, sf):
    """Paths and sizes differ from machine to machine, so the files' rows are added up."""
    files = pr.file_inventory(table(spark, sf, "lineitem"))
    return files.agg(F.sum("row_count").alias("row_count"), F.max("column_count").alias("column_count"), F.every(F.col("bytes") > 0).alias("sized"))


@query("document_stats", """
SELECT COALESCE(source, 'all') AS source, COUNT(*) AS documents, CAST(SUM(length(text)) AS BIGINT) AS total_characters,
       CAST(SUM(length(text)) // COUNT(*) AS BIGINT) AS average_doc_length
FROM documents GROUP BY GROUPING SETS ((source), ())""")
def document_stats(spark, sf):
    from govspark.operators.chunk import document_stats as stats

    return stats(table(spark, sf, "documents"))


@query("collection_stats", """
SELECT label AS source, COUNT(*) AS chunks, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total_chunks FROM embeddings GROUP BY label""")
def collection_stats(spark, sf):
    from govspark.operators.vector import collection_stats as stats

    return stats(table(spark, sf, "embeddings"), "label")


@query("load_table_verify", "SELECT COUNT(*) AS rows_before, COUNT(*) AS rows_after, TRUE AS complete FROM orders")
def load_table_verify(spark, sf):
    from govspark.scratch import run_dir
    from govspark.sources.sinks import load_table

    return load_table(proposals(spark, sf), run_dir(spark, "load"))
