"""Standings of voters kept up to date: every load adds sums and counts per voter, no vote is read twice.

A load writes its own part, so that the same load again changes nothing. ``fold`` adds up all parts that are there into one
stored total and notes which; readers take the last whole total and the parts behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.functions import predicates as p
from govspark.operators.topk import topk_with_total
from govspark.plans.voting import MONEY

PART = "voter bigint, power decimal(38,2), votes bigint, broken boolean"


def voter_sums(votes: DataFrame, power: DataFrame) -> DataFrame:
    """(voter, power, votes, broken): sums of the votes that have a power; ``broken`` where a sum is beyond its digits."""
    joined = p.guarded(votes.select("voter", "parent_vote_id"), "voter").join(
        p.guarded(power, "self_voting_power").where(p.is_number("self_voting_power")), F.col("parent_vote_id") == F.col("id")
    )
    amount = F.col("self_voting_power").try_cast(MONEY)
    grouped = joined.groupBy("voter").agg(F.try_sum(amount).cast("decimal(38,2)").alias("power"), F.count("*").alias("votes"), F.count(amount).alias("n"))
    return grouped.select(F.col("voter").cast("bigint").alias("voter"), "power", "votes", (F.col("power").isNull() & (F.col("n") > 0)).alias("broken"))


def add_load(votes: DataFrame, power: DataFrame, store: str, load: str) -> None:
    voter_sums(votes, power).write.mode("overwrite").parquet(f"{store}/parts/load={load}")


def _totals(spark: SparkSession, store: str) -> tuple[int, list[str]]:
    """(number of the last whole total, loads in it); a total counts once its list of loads, written last, is there."""
    try:
        rows = spark.read.schema("load string, total bigint").parquet(f"{store}/folded").collect()
    except AnalysisException:
        return 0, []
    last = max((r.total for r in rows), default=0)
    return last, [r.load for r in rows if r.total == last and r.load is not None]


def _added(parts: DataFrame) -> DataFrame:
    summed = parts.groupBy("voter").agg(F.try_sum("power").cast("decimal(38,2)").alias("power"), F.sum("votes").alias("votes"), F.max("broken").alias("broken"), F.count("power").alias("n"))
    broken = F.col("broken") | (F.col("power").isNull() & (F.col("n") > 0))
    return summed.select("voter", F.when(~broken, F.col("power")).alias("power"), "votes", broken.alias("broken"))


def current(spark: SparkSession, store: str) -> DataFrame:
    """(voter, power, votes, broken) over all loads."""
    number, loads = _totals(spark, store)
    parts = spark.read.schema(PART + ", load string").parquet(f"{store}/parts")
    parts = [parts.where(~F.col("load").isin(loads)).drop("load") if loads else parts.drop("load")]
    if number:
        parts.append(spark.read.schema(PART).parquet(f"{store}/totals/{number}"))
    return _added(reduce(DataFrame.unionByName, parts))


def fold(spark: SparkSession, store: str) -> None:
    """All that is there as one stored total. Loads that come meanwhile stay parts of their own."""
    number, known = _totals(spark, store)
    loads = sorted({r.load for r in spark.read.schema(PART + ", load string").parquet(f"{store}/parts").select("load").distinct().collect()} | set(known))
    chosen = spark.read.schema(PART + ", load string").parquet(f"{store}/parts").where(F.col("load").isin([x for x in loads if x not in known])).drop("load")
    if number:
        chosen = chosen.unionByName(spark.read.schema(PART).parquet(f"{store}/totals/{number}"))
    _added(chosen).write.mode("overwrite").parquet(f"{store}/totals/{number + 1}")
    spark.createDataFrame([(x,) for x in loads], "load string").coalesce(1).write.mode("overwrite").parquet(f"{store}/folded/total={number + 1}")


def top_voters(spark: SparkSession, store: str, k: int = 10) -> DataFrame:
    """The same columns and order as the question over all votes."""
    rows = current(spark, store).select("voter", F.col("power").alias("total_voting_power"), F.col("votes").alias("vote_count"))
    top = topk_with_total(rows, [F.col("total_voting_power").desc_nulls_last(), F.col("voter").asc()], k)
    return top.withColumn("total_voting_power", F.col("total_voting_power").cast("double"))
