"""Running totals and positions inside groups of any size.

A window over one group runs in one task, so a group with a third of all rows would stall the job. Hot groups are looked
for first, on a sample that only steers the plan: missing one would cost time, never change a result. Where there is none, a plain window does.
Otherwise only the hot groups are cut along their order key into parts of about equal size (split points from one
approximate-quantile aggregate over their rows). Each part is summed on its own, and the totals of the parts before it,
a small table, are added.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.scratch import settle


def default_parts(df: DataFrame) -> int:
    """One part per shuffle partition, so that even a single group fills the cluster."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, key: Column, parts: int) -> list[float]:
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key.cast("double"), shares, 10_000).alias("cuts")).first()
    return sorted(set(row["cuts"] or [0.0]))


#: Rows of one group that a plain window may get, and sampled rows by which a larger group is told.
WINDOW_ROWS, SAMPLED_ROWS = 1_000_000, 10_000
#: Bytes of texts of one group, or of one part of it, that a window may get: rows with long texts are fewer.
WINDOW_BYTES = 64_000_000


def _sampled(df: DataFrame, window_rows: int) -> tuple[DataFrame, float]:
    share = min(1.0, SAMPLED_ROWS / max(window_rows, 1))
    return (df.sample(share, seed=11) if share < 1 else df), share


def _text_bytes(df: DataFrame, keys: list[str]) -> Column:
    """Bytes of a row's texts that are no keys."""
    texts = [name for name, kind in df.dtypes if kind in ("string", "binary") and name not in keys]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0)).cast("bigint")


def _hot(df: DataFrame, keys: list[str], window_rows: int, window_bytes: float) -> DataFrame:
    sample, share = _sampled(df.select(*keys, _text_bytes(df, keys).alias("_bytes")), window_rows)
    counted = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.sum("_bytes") / share).alias("_bytes"))
    hot = counted.where((F.col("_n") > window_rows * share) | (F.col("_bytes") > window_bytes))
    return settle(hot.select(*keys, F.lit(True).alias("_hot"), "_bytes"), "hot-groups")


def hot_groups(df: DataFrame, keys: list[str], window_rows: int) -> DataFrame:
    """Keys of the groups with about ``window_rows`` rows or more: at most as many as the rows divided by that."""
    return _hot(df.select(*keys), keys, window_rows, math.inf).drop("_bytes")


def _free_lead(names: list[str]) -> str:
    """Underscores that none of the names begins with: columns named by them hide no other column."""
    return "_" * (1 + max(len(n) - len(n.lstrip("_")) for n in ["", *names]))


def _null_free(df: DataFrame, group: list[str], lead: str) -> tuple[DataFrame, list[str]]:
    """Group keys without nulls, so that they can be joined on: per nullable column a filled one and a flag."""
    added, names = {}, []
    for i, name in enumerate(group):
        field = df.schema[name]
        filler = F.lit("1970-01-01" if field.dataType.typeName().startswith(("date", "timestamp")) else "0")
        added[f"{lead}g{i}"] = F.coalesce(F.col(name), filler.cast(field.dataType))
        names.append(f"{lead}g{i}")
        if field.nullable:
            added[f"{lead}g{i}_null"] = F.col(name).isNull()
            names.append(f"{lead}g{i}_null")
    return df.withColumns(added), names


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    measures: dict[str, Column],
    totals: bool = False,
    window_rows: int = WINDOW_ROWS,
    parts: int | None = None,
    window_bytes: int = WINDOW_BYTES,
) -> DataFrame:
    """Adds per measure its sum over the rows of the same group up to and including this row.

    A group of more than ``window_rows`` rows or ``window_bytes`` bytes of texts is cut into parts of at most about as many bytes.

    ``group`` columns are numbers, texts, dates or timestamps. ``order`` must be unique inside a group; its first column
    is numeric or a timestamp, has no nulls and spreads the rows. With ``totals`` also ``<name>_total``, the sum over
    the whole group.
    """
    names = list(measures)
    lead = _free_lead([*df.columns, *names])
    key_, cut_, part_, hot_ = (f"{lead}{x}" for x in ("key", "cut", "part", "hot"))
    measured, keys = _null_free(df.withColumns({f"{lead}m_{n}": m for n, m in measures.items()}), group, lead)
    internal = [*keys, *[f"{lead}m_{n}" for n in names]]

    def inside(*by: str) -> dict[str, Column]:
        whole = W.partitionBy(*by)
        up_to = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        sums = {n: F.sum(f"{lead}m_{n}").over(up_to) for n in names}
        return sums | ({f"{n}_total": F.sum(f"{lead}m_{n}").over(whole) for n in names} if totals else {})

    hot = _hot(measured, keys, window_rows, window_bytes)
    held = hot.agg(F.sum("_bytes")).first()[0]
    if held is None:
        return measured.withColumns(inside(*keys)).drop(*internal)
    parts = parts or max(default_parts(df), math.ceil(held / window_bytes))
    hot = hot.drop("_bytes").withColumnRenamed("_hot", hot_)

    key = F.col(order[0])
    if dict(df.dtypes)[order[0]].startswith("timestamp"):
        key = F.unix_micros(key.cast("timestamp"))
    flagged = measured.join(hot, keys, "left").withColumn(key_, F.coalesce(key.cast("double"), F.lit(float("-inf"))))
    # Any split points are right; sampled ones are near enough to even.
    rows, _ = _sampled(flagged.where(hot_).select(key_), window_rows)
    cuts = split_points(rows, F.col(key_), parts)
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol=key_, outputCol=cut_, handleInvalid="keep"
    )
    cut = bucketizer.transform(flagged).withColumn(part_, F.when(F.col(hot_), F.col(cut_)).otherwise(-1.0))

    per_part = cut.where(hot_).groupBy(*keys, part_).agg(*[F.sum(f"{lead}m_{n}").alias(f"{lead}p_{n}") for n in names])
    before = W.partitionBy(*keys).orderBy(part_).rowsBetween(W.unboundedPreceding, -1)
    added = {f"{lead}b_{n}": F.sum(f"{lead}p_{n}").over(before) for n in names}
    if totals:
        added |= {f"{lead}t_{n}": F.sum(f"{lead}p_{n}").over(W.partitionBy(*keys)) for n in names}
    offsets = per_part.withColumns(added).drop(*[f"{lead}p_{n}" for n in names])

    joined = cut.withColumns(inside(*keys, part_)).join(offsets, [*keys, part_], "left")
    out = {n: F.col(n) + F.coalesce(f"{lead}b_{n}", F.lit(0)) for n in names}
    if totals:
        out |= {f"{n}_total": F.coalesce(f"{lead}t_{n}", f"{n}_total") for n in names}
    return joined.withColumns(out).drop(*internal, hot_, key_, cut_, part_, *[f"{lead}{p}_{n}" for n in names for p in "bt"])


def positions(
    df: DataFrame, group: list[str], order: list[str], name: str = "row_number", totals: bool = False, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """1-based position of every row in its group; with ``totals`` also ``<name>_total``, the size of the group."""
    return running(df, group, order, {name: F.lit(1).cast("bigint")}, totals, window_rows)
