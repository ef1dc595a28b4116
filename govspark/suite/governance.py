"""Governance templates on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.functions import amounts
from govspark.functions import predicates as p
from govspark.operators.topk import topk_with_total
from govspark.plans import governance as g
from govspark.sources.tables import proposals, proposer_networks, table
from govspark.suite.registry import query

GOV = """
gov AS (
  SELECT o_orderkey AS proposal_index, o_custkey AS proposer, o_orderstatus AS status,
         o_orderpriority AS proposal_type, o_orderdate AS createdat, o_totalprice AS amount, r_name AS network
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)
"""
LIST = "SELECT proposal_index, status, createdat, network, proposal_type, COUNT(*) OVER () AS total_count FROM gov"
NEWEST = "ORDER BY createdat DESC NULLS LAST, proposal_index LIMIT 10"

# The asset of an order, spread over every branch of the amount rules; low-priority orders carry NaN.
ASSET_SQL = """
assets AS (
  SELECT o_orderkey AS proposal_index, o_orderdate AS createdat,
         CASE o_orderpriority WHEN '1-URGENT' THEN 1984 WHEN '2-HIGH' THEN 1337 WHEN '3-MEDIUM' THEN 30
              WHEN '5-LOW' THEN 99 END AS asset_id,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN CAST('NaN' AS DOUBLE)
              ELSE o_totalprice END AS amount
  FROM orders)
"""


def with_assets(rows: DataFrame) -> DataFrame:
    kind = F.col("proposal_type")
    asset = (
        F.when(kind == "1-URGENT", 1984).when(kind == "2-HIGH", 1337).when(kind == "3-MEDIUM", 30)
        .when(kind == "5-LOW", 99)
    )
    missing = (kind == "5-LOW") & (F.col("status") == "P")
    return rows.withColumn("asset_id", asset).withColumn("amount", F.when(missing, float("nan")).otherwise(F.col("amount")))


def _list(spark, sf, *conditions):
    return g.listing(proposals(spark, sf), proposer_networks(spark, sf), *conditions)


@query("g_recent", f"WITH {GOV} {LIST} WHERE createdat IS NOT NULL {NEWEST}")
def g_recent(spark, sf):
    return _list(spark, sf)


@query("g_by_network", f"WITH {GOV} {LIST} WHERE network = 'ASIA' AND createdat IS NOT NULL {NEWEST}")
def g_by_network(spark, sf):
    return g.listing_by_network(proposals(spark, sf), proposer_networks(spark, sf), "ASIA")


@query("g_by_type_like", f"WITH {GOV} {LIST} WHERE proposal_type ILIKE '%urgent%' AND createdat IS NOT NULL {NEWEST}")
def g_by_type_like(spark, sf):
    return _list(spark, sf, p.contains_ci("urgent", "proposal_type"))


@query("g_text_search", """
WITH titled AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text, source, n_chars FROM documents)
SELECT doc_id, title, source, n_chars, COUNT(*) OVER () AS total_count FROM titled
WHERE text ILIKE '%tion the%' OR title ILIKE '%tion the%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10""")
def g_text_search(spark, sf):
    return g.text_search(table(spark, sf, "documents"), "tion the")


@query("g_by_id", f"WITH {GOV} {LIST} WHERE proposal_index = 1234 AND createdat IS NOT NULL {NEWEST}")
def g_by_id(spark, sf):
    return _list(spark, sf, F.col("proposal_index") == 1234)


@query("g_after", f"WITH {GOV} {LIST} WHERE createdat > DATE '2000-01-01' {NEWEST}")
def g_after(spark, sf):
    return _list(spark, sf, g.after(dt.date(2000, 1, 1)))


@query("g_before", f"WITH {GOV} {LIST} WHERE createdat < DATE '1996-01-01' {NEWEST}")
def g_before(spark, sf):
    return _list(spark, sf, g.before(dt.date(1996, 1, 1)))


@query("g_between", f"WITH {GOV} {LIST} WHERE createdat BETWEEN DATE '1997-01-01' AND DATE '1997-01-31' {NEWEST}")
def g_between(spark, sf):
    return _list(spark, sf, p.between("createdat", dt.date(1997, 1, 1), dt.date(1997, 1, 31)))


@query("g_count", "SELECT COUNT(*) AS total_proposals FROM orders")
def g_count(spark, sf):
    return g.count_all(proposals(spark, sf))


@query("g_amounts", f"""
WITH {ASSET_SQL}, listed AS (
  SELECT *, COUNT(*) OVER () AS total_count FROM assets WHERE amount IS NOT NULL AND NOT isnan(amount)
  ORDER BY createdat DESC NULLS LAST, proposal_index LIMIT 10)
SELECT proposal_index, createdat, asset_id, amount, total_count,
       format('{{:,.2f}}', scaled) AS amount_formatted, format('{{:,.2f}}', scaled) || label AS amount_display
FROM (SELECT *, CASE WHEN asset_id IN (1984, 1337) THEN amount / 1e6 WHEN asset_id = 30 THEN amount / 1e3 ELSE amount
              END AS scaled,
             CASE WHEN asset_id = 1984 THEN ' USDT' WHEN asset_id = 1337 THEN ' USDC' WHEN asset_id = 30 THEN ' DED'
                  WHEN asset_id IS NULL THEN ' DOT' ELSE ' (Asset ID: ' || asset_id || ')' END AS label FROM listed)""")
def g_amounts(spark, sf):
    rows = with_assets(proposals(spark, sf)).where(p.is_number("amount"))
    rows = rows.select("proposal_index", "createdat", "asset_id", "amount")
    return amounts.with_display(topk_with_total(rows, g.newest_first()), "amount", "asset_id")


@query("g_all_by_date", f"WITH {GOV} {LIST} {NEWEST}")
def g_all_by_date(spark, sf):
    return g.listing_nulls_last(proposals(spark, sf), proposer_networks(spark, sf))


@query("g_month_count",
       "SELECT COUNT(*) AS total_proposals FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1997-08-01'")
def g_month_count(spark, sf):
    return g.count_all(g.in_month(proposals(spark, sf), 1997, 8))


@query("g_month_examples", f"WITH {GOV} {LIST} WHERE date_trunc('month', createdat) = DATE '1997-08-01' {NEWEST}")
def g_month_examples(spark, sf):
    return _list(spark, sf, p.in_month("createdat", 1997, 8))


@query("g_network_count", f"WITH {GOV} SELECT COUNT(*) AS network_count FROM gov WHERE network = 'EUROPE'")
def g_network_count(spark, sf):
    return g.count_by_network(proposals(spark, sf), proposer_networks(spark, sf), "EUROPE")


@query("g_network_examples", f"WITH {GOV} {LIST} WHERE network = 'EUROPE' AND createdat IS NOT NULL {NEWEST}")
def g_network_examples(spark, sf):
    return g.listing_by_network(proposals(spark, sf), proposer_networks(spark, sf), "EUROPE")


@query("g_max_amount_month", f"""
WITH {ASSET_SQL}
SELECT proposal_index, asset_id, amount, createdat FROM assets
WHERE date_trunc('month', createdat) = DATE '1997-08-01' AND amount IS NOT NULL AND NOT isnan(amount)
ORDER BY amount DESC, proposal_index LIMIT 1""")
def g_max_amount_month(spark, sf):
    return g.largest_amount(with_assets(proposals(spark, sf)), 1997, 8)


# Order states stand for statuses: P is in voting, O is submitted, F is finished.
STATUS_NAMES = {"P": "Deciding", "O": "Submitted", "F": "Executed"}


@query("g_in_voting", f"""
WITH {GOV} {LIST} WHERE status IN ('P', 'O') AND createdat IS NOT NULL {NEWEST}""")
def g_in_voting(spark, sf):
    codes = [code for code, name in STATUS_NAMES.items() if name in p.VOTING_STATUSES]
    return _list(spark, sf, F.col("status").isin(codes))


@query("g_approval_rate", """
SELECT o_orderpriority AS proposal_type, COUNT(*) AS decided, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS approved,
       ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F') / COUNT(*), 6) AS approval_rate
FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority""")
def g_approval_rate(spark, sf):
    return g.approval_rate(proposals(spark, sf), "F", ["F", "P"])


@query("g_active_proposers", """
SELECT o_custkey AS proposer, COUNT(*) AS proposals FROM orders GROUP BY o_custkey
ORDER BY proposals DESC, proposer LIMIT 10""")
def g_active_proposers(spark, sf):
    return g.active_proposers(proposals(spark, sf))


@query("g_network_compare", f"""
WITH {GOV}
SELECT network, COUNT(*) AS proposals, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM gov WHERE network IS NOT NULL GROUP BY network""")
def g_network_compare(spark, sf):
    return g.compare_networks(proposals(spark, sf), proposer_networks(spark, sf))


@query("active_accounts", """
SELECT DISTINCT user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAYS""")
def active_accounts(spark, sf):
    return g.active_accounts(table(spark, sf, "events"), 2)
