"""Key diffs between a batch and a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.operators.ordered import WINDOW_ROWS, hot_groups

#: Largest number of keys that is broadcast; with keys of up to ~100 bytes this stays below 100 MB.
BROADCAST_KEYS = 1_000_000


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def new_records(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``target``; rows without key are no records. Both sides move as keys of one column."""
    return source.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")


def new_records_of_small_batch(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """As ``new_records`` for a batch that may be far smaller than the table.

    The batch's keys are counted first. When they are few they are broadcast to the key scan of the table, which is
    then not shuffled; otherwise both sides are shuffled by key.
    """
    keys = distinct_keys(source, key)
    if keys.count() > BROADCAST_KEYS:
        return new_records(source, target, key)
    known = target.select(key).join(F.broadcast(keys), key, "left_semi").distinct()
    return source.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def keep_keys(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return source.join(keys.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def except_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return distinct_keys(left, key).join(right.select(key), key, "left_anti")


def salted_join(many: DataFrame, one: DataFrame, key: str, group_rows: int = WINDOW_ROWS, salts: int = 64) -> DataFrame:
    """Inner join of rows to a table that has ``key`` unique, for results that are grouped by the same key next.

    There AQE does not split a hot key, since that would undo the partitioning the grouping relies on. Hot keys, found on
    a sample, are split by salt, and only their rows of ``one`` are repeated per salt.
    """
    hot = hot_groups(many.where(F.col(key).isNotNull()), [key], group_rows)
    if hot.isEmpty():
        return many.join(one, key)
    others = [c for c in many.columns if c != key]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(0).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")
