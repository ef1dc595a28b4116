"""Parquet tables and the governance-shaped views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per proposal, without its network."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("proposal_index"),
        F.col("o_custkey").alias("proposer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("proposal_type"),
        F.col("o_orderdate").alias("createdat"),
        F.col("o_totalprice").alias("amount"),
    )


def proposer_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposer to network; the two dimension tables are broadcast by Spark when their size allows it."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("proposer"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("network"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("proposer", "network")
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vote."""
    delegated = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("parent_vote_id"),
        F.col("l_suppkey").alias("voter"),
        F.col("l_partkey").alias("proposal_index"),
        F.col("l_returnflag").alias("decision"),
        delegated.alias("is_delegated"),
        F.when(delegated, F.col("l_suppkey") + 1).alias("delegated_to"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("removed_at"),
        (F.col("l_linenumber") - 1).alias("lock_period"),
    )


def voting_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote id to its own voting power; ``id`` is the primary key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("self_voting_power")
    )
