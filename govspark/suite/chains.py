"""Whole chains on the test tables: ingest of proposals and votes, search and answer inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.functions import coerce
from govspark.operators import joins, vector
from govspark.operators import retrieval as r
from govspark.plans import ingest
from govspark.plans import retrieval as chain
from govspark.sources.tables import table
from govspark.suite import retrieval as rs
from govspark.suite.registry import query


def raw_orders(spark, sf):
    """Orders as JSON items of files in two networks, with fields that only some files have."""
    network = F.when(F.col("o_orderstatus") == "F", "polkadot").otherwise("kusama")
    is_urgent = F.col("o_orderpriority") == "1-URGENT"
    kind = F.when(is_urgent, "ReferendumV2").otherwise("Bounty")
    item = F.struct(
        F.col("o_orderkey").alias("index"),
        F.col("o_orderdate").cast("string").alias("createdAt"),
        F.when(is_urgent, F.concat_ws(" ", F.lit("Order"), "o_orderkey")).alias("title"),
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.md5(F.col("o_orderkey").cast("string")).alias("hash"),
            F.when(is_urgent, F.array(F.struct(F.col("o_totalprice").alias("amount"), F.lit("30").alias("assetId")))).alias("beneficiaries"),
        ).alias("onChainInfo"),
        F.array(F.struct(F.lit("t0").alias("value")), F.struct(F.lit("t1").alias("value"))).alias("tags"),
        F.lit("x").alias("notCurated"),
    )
    return table(spark, sf, "orders").select(
        F.concat_ws("_", network, kind, F.lit("20240101.json")).alias("source_file"),
        F.col("o_orderkey").alias("pos"),
        F.to_json(item).alias("item"),
    )


INGEST_TYPES = coerce.schema_types({
    "index": {"data_type": "int64"}, "createdat": {"data_type": "datetime"}, "onchaininfo_beneficiaries_0_amount": {"data_type": "float64"}})


def ingested(spark, sf):
    return ingest.curated(ingest.wide_table(raw_orders(spark, sf)), INGEST_TYPES)[0]


INGEST_SQL = """
loaded AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'polkadot' ELSE 'kusama' END AS source_network, o_orderpriority = '1-URGENT' AS urgent, * FROM orders),
rows AS (
  SELECT source_network || '_' || CASE WHEN urgent THEN 'ReferendumV2' ELSE 'Bounty' END || '_20240101.json' AS source_file, source_network,
    CASE WHEN urgent THEN 'ReferendumV2' ELSE 'Bounty' END AS source_proposal_type, o_orderkey + 1 AS source_row_id, o_orderdate AS createdat,
    o_orderkey AS index, CASE WHEN urgent THEN o_totalprice END AS onchaininfo_beneficiaries_0_amount,
    CASE WHEN urgent THEN '30' END AS onchaininfo_beneficiaries_0_assetid, md5(CAST(o_orderkey AS VARCHAR)) AS onchaininfo_hash,
    o_orderstatus AS onchaininfo_status, 't0' AS tags_0_value, 't1' AS tags_1_value, CASE WHEN urgent THEN 'Order ' || o_orderkey END AS title,
    source_network || '_' || CASE WHEN urgent THEN 'ReferendumV2' ELSE 'Bounty' END || '_' || o_orderkey || '_' || md5(CAST(o_orderkey AS VARCHAR)) AS row_index
  FROM loaded)"""


@query("ingest_proposals", f"WITH {INGEST_SQL} SELECT * FROM rows")
def ingest_proposals(spark, sf):
    return ingested(spark, sf).withColumn("index", F.col("index").cast("bigint"))


@query("ingest_new_rows", f"WITH {INGEST_SQL} SELECT row_index, createdat FROM rows WHERE index NOT IN (SELECT l_orderkey FROM lineitem)")
def ingest_new_rows(spark, sf):
    rows = ingested(spark, sf)
    voted = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("decimal(38,0)").alias("index"))
    loaded = joins.keep_keys(rows, voted, "index").select("row_index")
    return ingest.new_rows(rows.select("row_index", "createdat"), loaded)


@query("flatten_votes", """
SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice * CASE WHEN l_linenumber = 1 THEN 0.1::DOUBLE ELSE (l_linenumber - 1)::DOUBLE END END AS balance_value,
  l_returnflag AS decision, CAST(l_linestatus = 'O' AS VARCHAR) AS "isDelegated", CAST(l_partkey AS VARCHAR) AS "postDetails_index",
  '{"likes":' || l_linenumber || '}' AS "postDetails_metrics", '["a' || l_suppkey || '","b"]' AS "postDetails_publicUser_addresses",
  CAST(l_suppkey AS VARCHAR) AS "voterAddress", CAST(l_linenumber - 1 AS VARCHAR) AS "lockPeriod", NULL AS "postDetails_title",
  CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS "index_voterAddress" FROM lineitem""")
def flatten_votes(spark, sf):
    balance = F.when(F.col("l_returnflag") == "N", "none").otherwise(F.col("l_extendedprice").cast("string"))
    record = F.struct(
        F.struct(balance.alias("value")).alias("balance"),
        F.col("l_returnflag").alias("decision"),
        (F.col("l_linestatus") == "O").alias("isDelegated"),
        F.struct(
            F.col("l_partkey").alias("index"),
            F.struct(F.col("l_linenumber").alias("likes")).alias("metrics"),
            F.struct(F.array(F.concat(F.lit("a"), F.col("l_suppkey")), F.lit("b")).alias("addresses")).alias("publicUser"),
        ).alias("postDetails"),
        F.col("l_suppkey").cast("string").alias("voterAddress"),
        (F.col("l_linenumber") - 1).alias("lockPeriod"),
    )
    records = table(spark, sf, "lineitem").select(F.parse_json(F.to_json(record)).alias("element"))
    return ingest.flat_votes(records).select(
        "balance_value", "decision", "isDelegated", "postDetails_index", "postDetails_metrics", "postDetails_publicUser_addresses",
        "voterAddress", "lockPeriod", "postDetails_title", "index_voterAddress",
    )


@query("search_documents", f"""
WITH {rs.hits_sql(where='label < 5', name='a')}, {rs.hits_sql(where='label >= 5', name='b').replace(rs.CENTROIDS + ',', '', 1)},
both_sides AS (SELECT query_id, vec_id, score, 'static' AS source FROM a UNION ALL SELECT query_id, vec_id, score, 'dynamic' FROM b)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM both_sides QUALIFY rank <= 10""")
def search_documents(spark, sf):
    v = rs.vectors(spark, sf)
    sides = {"static": v.where(F.col("label") < 5), "dynamic": v.where(F.col("label") >= 5)}
    return chain.search_collections(sides, vector.centroids(v, "label"), rs.K)


@query("answer_inputs", f"""
WITH {rs.hits_sql()}, {rs.PAYLOAD_SQL.replace('found AS', 'every AS')},
flagged AS (SELECT *, source = 'en' AS flag, max(score) OVER (PARTITION BY query_id) AS best FROM every),
near AS (SELECT *, bool_or(flag AND ROUND(best - score, 6) <= 0.05) OVER (PARTITION BY query_id) AS any_near FROM flagged),
found AS (SELECT * FROM near WHERE NOT any_near OR (flag AND ROUND(best - score, 6) <= 0.05)), {rs.packed_sql(8000)},
best AS (SELECT query_id, COUNT(*) AS chunks, max(score) AS max_score,
  round_even(least(avg(score) + least(COUNT(*) * 0.1::DOUBLE, 0.3::DOUBLE), 1.0::DOUBLE), 2) AS c FROM found GROUP BY query_id),
joined AS (SELECT query_id, COALESCE(chunks, 0) AS chunks, COALESCE(max_score, 0) AS max_score, c, context, COALESCE(context IS NOT NULL AND max_score > 0.35, FALSE) AS sufficient
  FROM cent LEFT JOIN best USING (query_id) LEFT JOIN packed USING (query_id))
SELECT query_id, chunks, max_score, sufficient, CASE WHEN sufficient THEN c ELSE 0 END AS confidence, CASE WHEN sufficient THEN context END AS context,
  CASE WHEN sufficient THEN NULL WHEN chunks = 0 THEN 'No relevant chunks found'
       WHEN max_score <= 0.3 THEN 'Low similarity scores (max: ' || format('{{:.3f}}', max_score) || ' < 0.3)'
       WHEN context IS NULL THEN 'Retrieved chunks contain no usable content (similarity: ' || format('{{:.3f}}', max_score) || ')'
       ELSE 'Unknown context issue' END AS reason FROM joined""")
def answer_inputs(spark, sf):
    queries = vector.centroids(rs.vectors(spark, sf), "label")
    return chain.answer_inputs(queries, rs.found(spark, sf), F.col("source") == "en", r.ANSWER_CHARS, 0.35, 0.3)
