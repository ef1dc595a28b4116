"""Filters, joins, top-k and set operations on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from govspark.functions import predicates as p
from govspark.functions import text as t
from govspark.operators import joins, union
from govspark.operators.spread import spread_scan
from govspark.operators.topk import topk_with_total
from govspark.plans import governance as g
from govspark.plans import voting as v
from govspark.sources.tables import proposals, proposer_networks, table, votes, voting_power
from govspark.suite.governance import GOV, with_assets, ASSET_SQL
from govspark.suite.registry import query
from govspark.suite.voting import TIES, VOTES

# Order priorities and states under the names of proposal types and statuses.
TYPED_SQL = """
typed AS (
  SELECT o_orderkey AS proposal_index, o_orderdate AS createdat, o_totalprice AS amount,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'ReferendumV2' WHEN '2-HIGH' THEN 'Bounty'
              WHEN '3-MEDIUM' THEN 'ChildBounty' WHEN '5-LOW' THEN 'FellowshipReferendum' ELSE 'Discussion' END AS proposal_type,
         CASE o_orderstatus WHEN 'P' THEN 'Deciding' WHEN 'F' THEN 'Executed'
              ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'DecisionDepositPlaced' ELSE 'Submitted' END END AS status
  FROM orders)
"""


def typed(spark, sf):
    kind, state = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_index"),
        F.col("o_orderdate").alias("createdat"),
        F.col("o_totalprice").alias("amount"),
        F.when(kind == "1-URGENT", "ReferendumV2").when(kind == "2-HIGH", "Bounty")
        .when(kind == "3-MEDIUM", "ChildBounty").when(kind == "5-LOW", "FellowshipReferendum")
        .otherwise("Discussion").alias("proposal_type"),
        F.when(state == "P", "Deciding").when(state == "F", "Executed")
        .when(kind == "1-URGENT", "DecisionDepositPlaced").otherwise("Submitted").alias("status"),
    )


@query("filter_eq", """
SELECT o_orderkey AS proposal_index, o_totalprice AS amount FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def filter_eq(spark, sf):
    return proposals(spark, sf).where(
        p.all_of(F.col("status") == "F", F.col("proposal_type") == "1-URGENT")
    ).select("proposal_index", "amount")


@query("filter_ilike", """
SELECT doc_id, source FROM documents WHERE text ILIKE '%THE AND%' OR source ILIKE '%SRC1%'""")
def filter_ilike(spark, sf):
    return table(spark, sf, "documents").where(
        p.contains_ci("THE AND", "text") | p.contains_ci("SRC1", "source")
    ).select("doc_id", "source")


@query("filter_date_range", """
SELECT o_orderkey AS proposal_index, o_orderdate AS createdat FROM orders
WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""")
def filter_date_range(spark, sf):
    return proposals(spark, sf).where(
        p.between("createdat", dt.date(1997, 1, 1), dt.date(1997, 6, 30))
    ).select("proposal_index", "createdat")


@query("filter_month", """
SELECT o_orderkey AS proposal_index, o_orderdate AS createdat FROM orders
WHERE date_trunc('month', o_orderdate) = DATE '1998-12-01'""")
def filter_month(spark, sf):
    return proposals(spark, sf).where(p.in_month("createdat", 1998, 12)).select("proposal_index", "createdat")


@query("null_guard", f"""
WITH {VOTES} SELECT voter, delegated_to, removed_at FROM votes
WHERE delegated_to IS NOT NULL AND removed_at IS NOT NULL""")
def null_guard(spark, sf):
    return p.guarded(votes(spark, sf), "delegated_to", "removed_at").select("voter", "delegated_to", "removed_at")


@query("nan_guard", f"""
WITH {ASSET_SQL} SELECT proposal_index, amount FROM assets WHERE amount IS NOT NULL AND NOT isnan(amount)""")
def nan_guard(spark, sf):
    return with_assets(proposals(spark, sf)).where(p.is_number("amount")).select("proposal_index", "amount")


@query("default_type_filter", f"""
WITH {TYPED_SQL} SELECT proposal_index, proposal_type FROM typed WHERE proposal_type = 'ReferendumV2'""")
def default_type_filter(spark, sf):
    return typed(spark, sf).where(p.of_type()).select("proposal_index", "proposal_type")


@query("filter_threshold", f"""
WITH {VOTES} SELECT parent_vote_id, voter, lock_period FROM votes WHERE lock_period >= 4""")
def filter_threshold(spark, sf):
    return votes(spark, sf).where(F.col("lock_period") >= 4).select("parent_vote_id", "voter", "lock_period")


@query("filter_flag", f"WITH {VOTES} SELECT parent_vote_id, voter, delegated_to FROM votes WHERE is_delegated")
def filter_flag(spark, sf):
    return votes(spark, sf).where("is_delegated").select("parent_vote_id", "voter", "delegated_to")


@query("filter_active", f"WITH {VOTES} SELECT parent_vote_id, voter, decision FROM votes WHERE removed_at IS NULL")
def filter_active(spark, sf):
    return votes(spark, sf).where(F.col("removed_at").isNull()).select("parent_vote_id", "voter", "decision")


@query("status_synonyms", f"""
WITH {TYPED_SQL} SELECT proposal_index, status FROM typed
WHERE status IN ('Deciding', 'DecisionDepositPlaced', 'Submitted', 'ConfirmStarted', 'ConfirmAborted')""")
def status_synonyms(spark, sf):
    return typed(spark, sf).where(F.col("status").isin(p.VOTING_STATUSES)).select("proposal_index", "status")


@query("meaningful_text", r"""
WITH split_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
trimmed AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM split_lines)
SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM trimmed
WHERE length(line) BETWEEN 10 AND 5000 AND NOT regexp_matches(line, '^[0-9\-\s.,:;]+$')
  AND len(regexp_extract_all(line, '\S+')) >= 3 AND NOT starts_with(line, 'http')
  AND len(list_distinct(string_split(replace(line, ' ', ''), ''))) >= 5""")
def meaningful_text(spark, sf):
    exploded = spread_scan(table(spark, sf, "documents")).select("doc_id", F.posexplode(t.lines(F.col("text"))).alias("line_no", "line"))
    return exploded.where(t.is_meaningful(F.col("line"))).withColumn("line", t.strip(F.col("line")))


@query("search_filters", """
SELECT doc_id, source, lang FROM documents
WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')""")
def search_filters(spark, sf):
    from govspark.operators.search import search_filter

    posts = table(spark, sf, "documents").withColumn("tags", F.array("source"))
    wanted = search_filter({"lang": "en", "source": None}, "tags", ["src1", "src2", "src3"])
    return posts.where(wanted).select("doc_id", "source", "lang")


@query("join_left_power", f"""
WITH {VOTES} SELECT parent_vote_id, voter, proposal_index, lock_period, self_voting_power
FROM votes AS main LEFT JOIN power AS cv ON main.parent_vote_id = cv.id""")
def join_left_power(spark, sf):
    return v.with_power(votes(spark, sf), voting_power(spark, sf)).select(*v.VOTE_KEY, "self_voting_power")


@query("new_records", """
SELECT o_orderkey AS parent_vote_id, o_totalprice AS amount FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def new_records(spark, sf):
    source = proposals(spark, sf).select(F.col("proposal_index").alias("parent_vote_id"), "amount")
    return joins.new_records(source, votes(spark, sf), "parent_vote_id")


@query("new_records_small_batch", """
SELECT o_orderkey AS parent_vote_id, o_totalprice AS amount FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def new_records_small_batch(spark, sf):
    source = proposals(spark, sf).select(F.col("proposal_index").alias("parent_vote_id"), "amount")
    return joins.new_records_of_small_batch(source, votes(spark, sf), "parent_vote_id")


@query("semi_keep", """
SELECT o_orderkey AS parent_vote_id, o_totalprice AS amount FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def semi_keep(spark, sf):
    source = proposals(spark, sf).select(F.col("proposal_index").alias("parent_vote_id"), "amount")
    return joins.keep_keys(source, votes(spark, sf).where(F.col("decision") == "R"), "parent_vote_id")


@query("except_keys", """
SELECT o_orderkey AS parent_vote_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem""")
def except_keys(spark, sf):
    source = proposals(spark, sf).select(F.col("proposal_index").alias("parent_vote_id"))
    return joins.except_keys(source, votes(spark, sf), "parent_vote_id")


@query("topk_with_total", f"""
WITH {VOTES} SELECT {TIES}, created_at, COUNT(*) OVER () AS total_count FROM votes
WHERE decision = 'A' AND created_at IS NOT NULL ORDER BY created_at DESC, {TIES} LIMIT 10""")
def topk(spark, sf):
    rows = p.guarded(votes(spark, sf), "created_at").where(F.col("decision") == "A")
    return topk_with_total(rows.select(*v.VOTE_KEY, "created_at"), [*v.newest_first(), *v.tie_break()], 10, counted=rows)


@query("grouped_topk_with_total", """
SELECT l_partkey AS proposal_index, COUNT(*) AS votes, COUNT(*) OVER () AS total_count FROM lineitem
GROUP BY l_partkey ORDER BY votes DESC, proposal_index LIMIT 10""")
def grouped_topk(spark, sf):
    grouped = votes(spark, sf).groupBy("proposal_index").agg(F.count(F.lit(1)).alias("votes"))
    order = [F.col("votes").desc(), F.col("proposal_index").asc()]
    return topk_with_total(grouped, order)


@query("recent_topk", """
SELECT o_orderkey AS proposal_index, o_orderdate AS createdat FROM orders WHERE o_orderdate IS NOT NULL
ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def recent_topk(spark, sf):
    return p.guarded(proposals(spark, sf), "createdat").orderBy(*g.newest_first()).limit(10).select("proposal_index", "createdat")


@query("recent_topk_nulls_last", f"""
WITH {VOTES} SELECT {TIES}, removed_at FROM votes ORDER BY removed_at DESC NULLS LAST, {TIES} LIMIT 10""")
def recent_topk_nulls_last(spark, sf):
    order = [F.col("removed_at").desc_nulls_last(), *v.tie_break()]
    return votes(spark, sf).orderBy(*order).limit(10).select(*v.VOTE_KEY, "removed_at")


@query("max_amount_in_month", """
SELECT o_orderkey AS proposal_index, o_totalprice AS amount FROM orders
WHERE date_trunc('month', o_orderdate) = DATE '1999-02-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def max_amount_in_month(spark, sf):
    rows = proposals(spark, sf).withColumn("asset_id", F.lit(None).cast("int"))
    return g.largest_amount(rows, 1999, 2).select("proposal_index", "amount")


@query("delegated_sample", f"""
WITH {VOTES} SELECT {TIES}, delegated_to FROM votes WHERE is_delegated ORDER BY {TIES} LIMIT 10""")
def delegated_sample(spark, sf):
    return votes(spark, sf).where("is_delegated").orderBy(*v.tie_break()).limit(10).select(*v.VOTE_KEY, "delegated_to")


@query("agg_count", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS delegated FROM lineitem""")
def agg_count(spark, sf):
    return votes(spark, sf).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("is_delegated"), 1)).alias("delegated")
    )


@query("agg_count_distinct", """
SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, COUNT(DISTINCT l_suppkey) AS voters FROM lineitem GROUP BY 1""")
def agg_count_distinct(spark, sf):
    month = F.date_trunc("month", "created_at").cast("timestamp_ntz")
    return votes(spark, sf).groupBy(month.alias("month")).agg(F.countDistinct("voter").alias("voters"))


@query("top_voters", """
SELECT l_suppkey AS voter, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS power, COUNT(*) AS n
FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_voters(spark, sf):
    grouped = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("voter")).agg(
        F.try_sum(F.col("l_extendedprice").try_cast("decimal(38,2)")).alias("power"), F.count(F.lit(1)).alias("n")
    )
    top = grouped.orderBy(F.col("power").desc(), "voter").limit(10)
    return top.withColumn("power", F.col("power").cast("double"))


@query("union_merge_schema", """
SELECT NULL AS s_suppkey, NULL AS s_name, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL AS s_nationkey,
       NULL AS s_acctbal, 'customer' AS source_file FROM customer
UNION ALL
SELECT s_suppkey, s_name, NULL, NULL, NULL, NULL, NULL, s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def union_merge_schema(spark, sf):
    return union.union_merge_schema(
        *[table(spark, sf, n).withColumn("source_file", F.lit(n)) for n in ("customer", "supplier")]
    )


@query("union_results", f"""
WITH {GOV}
SELECT 'finished' AS question, proposal_index, status, NULL AS amount FROM gov WHERE status = 'F'
UNION ALL SELECT 'large', proposal_index, NULL, amount FROM gov WHERE amount > 400000""")
def union_results(spark, sf):
    rows = proposals(spark, sf)
    return union.union_results({
        "finished": rows.where(F.col("status") == "F").select("proposal_index", "status"),
        "large": rows.where(F.col("amount") > 400000).select("proposal_index", "amount"),
    })


@query("project_strict", "SELECT o_orderkey AS proposal_index, o_orderstatus AS status FROM orders")
def project_strict(spark, sf):
    return union.project_strict(proposals(spark, sf), ["proposal_index", "status"])


@query("project_lenient", "SELECT o_orderkey AS proposal_index, o_totalprice AS amount FROM orders")
def project_lenient(spark, sf):
    rows, _, _ = union.project_lenient(proposals(spark, sf), ["proposal_index", "curator", "amount", "amount"])
    return rows
