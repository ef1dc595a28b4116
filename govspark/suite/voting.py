"""Voting templates on the test tables."""

from __future__ import annotations

from govspark.plans import voting as v
from govspark.sources.tables import votes, voting_power
from govspark.suite.registry import query

VOTES = """
votes AS (
  SELECT l_orderkey AS parent_vote_id, l_suppkey AS voter, l_partkey AS proposal_index, l_returnflag AS decision,
         l_linestatus = 'O' AS is_delegated, CASE WHEN l_linestatus = 'O' THEN l_suppkey + 1 END AS delegated_to,
         l_shipdate AS created_at, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS removed_at,
         l_linenumber - 1 AS lock_period
  FROM lineitem),
power AS (SELECT o_orderkey AS id, o_totalprice AS self_voting_power FROM orders)
"""
JOINED = "FROM votes AS main LEFT JOIN power AS cv ON main.parent_vote_id = cv.id"
TIES = "parent_vote_id, proposal_index, voter, lock_period"


@query("v_top_voters", f"""
WITH {VOTES}
SELECT voter, CAST(SUM(CAST(self_voting_power AS DECIMAL(18,2))) AS DOUBLE) AS total_voting_power,
       COUNT(*) AS vote_count, COUNT(*) OVER () AS total_count
{JOINED} WHERE self_voting_power IS NOT NULL AND voter IS NOT NULL
GROUP BY voter ORDER BY total_voting_power DESC, voter LIMIT 10""")
def v_top_voters(spark, sf):
    return v.top_voters(votes(spark, sf), voting_power(spark, sf))


@query("v_recent", f"""
WITH {VOTES}
SELECT voter, decision, self_voting_power, created_at, proposal_index, COUNT(*) OVER () AS total_count
{JOINED} WHERE created_at IS NOT NULL AND voter IS NOT NULL ORDER BY created_at DESC, {TIES} LIMIT 10""")
def v_recent(spark, sf):
    return v.recent(votes(spark, sf), voting_power(spark, sf))


@query("v_distinct_month", f"""
WITH {VOTES}
SELECT COUNT(DISTINCT voter) AS unique_voters FROM votes
WHERE voter IS NOT NULL AND date_trunc('month', created_at) = DATE '1997-07-01'""")
def v_distinct_month(spark, sf):
    return v.distinct_voters(votes(spark, sf), 1997, 7)


@query("v_over_power", f"""
WITH {VOTES}
SELECT voter, self_voting_power, COUNT(*) OVER () AS total_count
{JOINED} WHERE self_voting_power > 400000 AND voter IS NOT NULL
ORDER BY self_voting_power DESC, {TIES} LIMIT 10""")
def v_over_power(spark, sf):
    return v.over_power(votes(spark, sf), voting_power(spark, sf), 400000.0)


@query("v_on_proposal", f"""
WITH {VOTES}
SELECT voter, decision, self_voting_power, created_at, COUNT(*) OVER () AS total_count
{JOINED} WHERE proposal_index = 123 AND voter IS NOT NULL""")
def v_on_proposal(spark, sf):
    return v.on_proposal(votes(spark, sf), voting_power(spark, sf), 123)


@query("v_delegated", f"""
WITH {VOTES}
SELECT voter, delegated_to, decision, self_voting_power, proposal_index, COUNT(*) OVER () AS total_count
{JOINED} WHERE is_delegated AND voter IS NOT NULL ORDER BY {TIES} LIMIT 10""")
def v_delegated(spark, sf):
    return v.delegated(votes(spark, sf), voting_power(spark, sf))


@query("v_active", f"""
WITH {VOTES}
SELECT voter, decision, self_voting_power, created_at, proposal_index, COUNT(*) OVER () AS total_count
{JOINED} WHERE removed_at IS NULL AND created_at IS NOT NULL AND voter IS NOT NULL
ORDER BY created_at DESC, {TIES} LIMIT 10""")
def v_active(spark, sf):
    return v.active(votes(spark, sf), voting_power(spark, sf))


@query("v_conviction", f"""
WITH {VOTES}
SELECT voter, decision, self_voting_power, lock_period, proposal_index, COUNT(*) OVER () AS total_count
{JOINED} WHERE lock_period >= 4 AND voter IS NOT NULL ORDER BY lock_period DESC, {TIES} LIMIT 10""")
def v_conviction(spark, sf):
    return v.conviction(votes(spark, sf), voting_power(spark, sf), 4)


@query("v_all_by_date", f"""
WITH {VOTES}
SELECT voter, decision, created_at, COUNT(*) OVER () AS total_count FROM votes
ORDER BY created_at DESC NULLS LAST, {TIES} LIMIT 10""")
def v_all_by_date(spark, sf):
    return v.all_by_date(votes(spark, sf))


@query("v_month_count", f"""
WITH {VOTES}
SELECT COUNT(DISTINCT voter) AS total_voters FROM votes
WHERE voter IS NOT NULL AND date_trunc('month', created_at) = DATE '1998-07-01'""")
def v_month_count(spark, sf):
    return v.distinct_voters(votes(spark, sf), 1998, 7, "total_voters")


@query("v_month_examples", f"""
WITH {VOTES}
SELECT voter, decision, self_voting_power, created_at, proposal_index, COUNT(*) OVER () AS total_count
{JOINED} WHERE voter IS NOT NULL AND date_trunc('month', created_at) = DATE '1998-07-01'
ORDER BY created_at DESC, {TIES} LIMIT 10""")
def v_month_examples(spark, sf):
    return v.month_examples(votes(spark, sf), voting_power(spark, sf), 1998, 7)
