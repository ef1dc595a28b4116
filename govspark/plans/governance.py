"""Question templates over proposals. Builders are lazy, but for reports that look up the network of their few rows: those
run the ranking while they build.

``proposals`` has proposal_index, proposer, status, proposal_type, createdat, amount; ``networks`` maps a proposer to
its network, one row per proposer. The network is a lookup on a unique key, so it never changes the number of rows:
templates that do not filter on it take their top rows first and look the network up for those rows only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import predicates as p
from govspark.operators.topk import lookup_for_few, topk_with_total

KEY_COLUMNS = ["proposal_index", "status", "createdat", "network", "proposal_type"]


def newest_first() -> list[Column]:
    return [F.col("createdat").desc_nulls_last(), F.col("proposal_index").asc()]


def _newest(matching: DataFrame, networks: DataFrame, k: int) -> DataFrame:
    columns = [c for c in KEY_COLUMNS if c != "network"]
    top = topk_with_total(matching.select(*columns, "proposer"), newest_first(), k, counted=matching)
    return lookup_for_few(top, networks, "proposer", k).select(*KEY_COLUMNS, "total_count")


def listing(proposals: DataFrame, networks: DataFrame, *conditions: Column, k: int = 10) -> DataFrame:
    """Newest proposals under any conditions on proposal columns."""
    return _newest(p.guarded(proposals, "createdat").where(p.all_of(*conditions)), networks, k)


def listing_nulls_last(proposals: DataFrame, networks: DataFrame, k: int = 10) -> DataFrame:
    """Newest proposals with undated ones kept at the end."""
    return _newest(proposals, networks, k)


def listing_by_network(proposals: DataFrame, networks: DataFrame, network: str, k: int = 10) -> DataFrame:
    here = networks.where(F.col("network") == network)
    matching = p.guarded(proposals, "createdat").join(here, "proposer").select(*KEY_COLUMNS)
    return topk_with_total(matching, newest_first(), k)


def count_by_network(proposals: DataFrame, networks: DataFrame, network: str) -> DataFrame:
    here = networks.where(F.col("network") == network)
    return proposals.join(here, "proposer").agg(F.count(F.lit(1)).alias("network_count"))


def text_search(documents: DataFrame, needle: str, k: int = 10) -> DataFrame:
    """Text in content or title, longest documents first; the title is the first line."""
    titled = documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", "source", "n_chars")
    matching = titled.where(p.contains_ci(needle, "text", "title"))
    order = [F.col("n_chars").desc_nulls_last(), F.col("doc_id").asc()]
    return topk_with_total(matching.drop("text"), order, k, counted=matching)


def count_all(proposals: DataFrame, *conditions: Column) -> DataFrame:
    return proposals.where(p.all_of(*conditions)).agg(F.count(F.lit(1)).alias("total_proposals"))


def in_month(proposals: DataFrame, year: int, month: int) -> DataFrame:
    return proposals.where(p.in_month("createdat", year, month))


def largest_amount(proposals: DataFrame, year: int, month: int) -> DataFrame:
    """The single largest amount of a month."""
    ranked = in_month(proposals, year, month).where(p.is_number("amount"))
    return (
        ranked.orderBy(F.col("amount").cast("double").desc_nulls_last(), F.col("proposal_index"))
        .limit(1)
        .select("proposal_index", "asset_id", "amount", "createdat")
    )


def approval_rate(proposals: DataFrame, approved: str, decided: list[str]) -> DataFrame:
    """Share of decided proposals that were approved, per type."""
    counted = (
        proposals.where(F.col("status").isin(decided))
        .groupBy("proposal_type")
        .agg(
            F.count(F.lit(1)).alias("decided"),
            F.sum(F.when(F.col("status") == approved, 1).otherwise(0)).alias("approved"),
        )
    )
    return counted.withColumn("approval_rate", F.round(F.col("approved") / F.col("decided"), 6))


def active_proposers(proposals: DataFrame, k: int = 10) -> DataFrame:
    counted = proposals.groupBy("proposer").agg(F.count(F.lit(1)).alias("proposals"))
    return counted.orderBy(F.col("proposals").desc(), F.col("proposer").asc()).limit(k)


def compare_networks(proposals: DataFrame, networks: DataFrame) -> DataFrame:
    """Counts and amounts per network; aggregated per proposer before the lookup, so a busy proposer moves as one row."""
    per_proposer = proposals.groupBy("proposer").agg(
        F.count(F.lit(1)).alias("n"), F.try_sum(F.when(p.is_number("amount"), F.col("amount")).try_cast("decimal(38,2)")).alias("total")
    )
    return (
        per_proposer.join(networks, "proposer")
        .groupBy("network")
        .agg(F.sum("n").alias("proposals"), F.try_sum("total").cast("double").alias("total_amount"))
    )


def active_accounts(events: DataFrame, days: int) -> DataFrame:
    """Distinct accounts seen in the last ``days`` days of the data."""
    latest = events.agg(F.max("ts")).scalar()
    recent = events.where(F.col("ts") >= latest - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.select("user_id").distinct()


def after(moment: dt.date) -> Column:
    return F.col("createdat") > p.ntz(moment)


def before(moment: dt.date) -> Column:
    return F.col("createdat") < p.ntz(moment)
