"""Question templates over votes and their voting power.

A vote refers to one power row by ``parent_vote_id``; ``power.id`` is a primary key, so the left join neither adds nor
drops votes. Templates without a condition on power therefore rank and count votes alone and look the power up for the
rows they return; templates with such a condition join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import predicates as p
from govspark.operators.topk import lookup_for_few, topk_with_total

#: The widest type of sums with two decimals.
MONEY = "decimal(38,2)"
VOTE_KEY = ["parent_vote_id", "proposal_index", "voter", "lock_period"]


def tie_break() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in VOTE_KEY]


def with_power(votes: DataFrame, power: DataFrame) -> DataFrame:
    """LEFT JOIN votes to voting power."""
    return votes.join(power, F.col("parent_vote_id") == F.col("id"), "left").drop("id")


def ranked(votes: DataFrame, power: DataFrame, first: list[Column], columns: list[str], k: int = 10) -> DataFrame:
    """Top votes with the count of all of them and the power of those returned."""
    wanted = [c for c in columns if c != "self_voting_power"]
    needed = list(dict.fromkeys([*wanted, *VOTE_KEY]))
    top = topk_with_total(votes.select(*needed), [*first, *tie_break()], k, counted=votes)
    if "self_voting_power" in columns:
        top = lookup_for_few(top, power.withColumnRenamed("id", "parent_vote_id"), "parent_vote_id", k)
    return top.select(*columns, "total_count")


def newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_last()]


def recent(votes: DataFrame, power: DataFrame) -> DataFrame:
    columns = ["voter", "decision", "self_voting_power", "created_at", "proposal_index"]
    return ranked(p.guarded(votes, "created_at", "voter"), power, newest_first(), columns)


def distinct_voters(votes: DataFrame, year: int, month: int, name: str = "unique_voters") -> DataFrame:
    month_votes = p.guarded(votes, "voter").where(p.in_month("created_at", year, month))
    return month_votes.agg(F.countDistinct("voter").alias(name))


def over_power(votes: DataFrame, power: DataFrame, threshold: float, k: int = 10) -> DataFrame:
    strong = p.guarded(power, "self_voting_power").where(p.is_number("self_voting_power") & (F.col("self_voting_power") > threshold))
    joined = p.guarded(votes, "voter").join(strong, F.col("parent_vote_id") == F.col("id"))
    rows = joined.select("voter", "self_voting_power", *[c for c in VOTE_KEY if c != "voter"])
    order = [F.col("self_voting_power").desc_nulls_last(), *tie_break()]
    return topk_with_total(rows, order, k).select("voter", "self_voting_power", "total_count")


def on_proposal(votes: DataFrame, power: DataFrame, proposal_index: int) -> DataFrame:
    """Every vote on one proposal."""
    matching = p.guarded(votes, "voter").where(F.col("proposal_index") == proposal_index)
    total = matching.agg(F.count(F.lit(1))).scalar()
    return (
        with_power(matching, power)
        .withColumn("total_count", total)
        .select("voter", "decision", "self_voting_power", "created_at", "total_count")
    )


def delegated(votes: DataFrame, power: DataFrame) -> DataFrame:
    columns = ["voter", "delegated_to", "decision", "self_voting_power", "proposal_index"]
    return ranked(p.guarded(votes, "voter").where("is_delegated"), power, [], columns)


def active(votes: DataFrame, power: DataFrame) -> DataFrame:
    columns = ["voter", "decision", "self_voting_power", "created_at", "proposal_index"]
    still = p.guarded(votes, "created_at", "voter").where(F.col("removed_at").isNull())
    return ranked(still, power, newest_first(), columns)


def conviction(votes: DataFrame, power: DataFrame, lock_period: int) -> DataFrame:
    columns = ["voter", "decision", "self_voting_power", "lock_period", "proposal_index"]
    locked = p.guarded(votes, "voter").where(F.col("lock_period") >= lock_period)
    return ranked(locked, power, [F.col("lock_period").desc_nulls_last()], columns)


def top_voters(votes: DataFrame, power: DataFrame, k: int = 10) -> DataFrame:
    """Voters by total power; NaN and missing powers are no votes. Sums are decimal, so the result does not depend on the
    order of addition. A single power beyond 36 digits does not count; a sum beyond them is null and comes last.
    """
    joined = p.guarded(votes.select("voter", "parent_vote_id"), "voter").join(
        p.guarded(power, "self_voting_power").where(p.is_number("self_voting_power")), F.col("parent_vote_id") == F.col("id")
    )
    grouped = joined.groupBy("voter").agg(
        F.try_sum(F.col("self_voting_power").try_cast(MONEY)).alias("total_voting_power"),
        F.count(F.lit(1)).alias("vote_count"),
    )
    order = [F.col("total_voting_power").desc_nulls_last(), F.col("voter").asc()]
    top = topk_with_total(grouped, order, k)
    return top.withColumn("total_voting_power", F.col("total_voting_power").cast("double"))


def all_by_date(votes: DataFrame) -> DataFrame:
    return ranked(votes, votes, newest_first(), ["voter", "decision", "created_at"])


def month_examples(votes: DataFrame, power: DataFrame, year: int, month: int) -> DataFrame:
    columns = ["voter", "decision", "self_voting_power", "created_at", "proposal_index"]
    month_votes = p.guarded(votes, "voter").where(p.in_month("created_at", year, month))
    return ranked(month_votes, power, newest_first(), columns)
