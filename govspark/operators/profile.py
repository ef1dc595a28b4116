"""Column profiles.

Exact profiles turn the table into (column, value) pairs and count them: one shuffle with map-side counts serves the
null count, the distinct count and the samples of all columns, however skewed the values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Name patterns of the column roles; the first role that matches wins.
ROLE_PATTERNS = [
    ("key", ["id", "hash", "address", "proposer", "beneficiary"]),
    ("date", ["created_at", "updated_at", "timestamp", "date", "time"]),
    ("numeric", ["amount", "reward", "balance", "value", "count", "index"]),
    ("status", ["status", "state", "phase"]),
    ("content", ["title", "content", "description", "name"]),
]

# A column is common above this share of files, rare up to this number of files.
COMMON_SHARE, RARE_FILES = 0.5, 3


def role_of(name: str) -> str:
    lowered = name.lower()
    return next((role for role, parts in ROLE_PATTERNS if any(p in lowered for p in parts)), "other")


def role_column(name: Column) -> Column:
    """The same rule over a column of names."""
    lowered = F.lower(name)
    chosen = F.when(F.lit(False), F.lit(""))
    for role, parts in ROLE_PATTERNS:
        chosen = chosen.when(lowered.rlike("|".join(parts)), F.lit(role))
    return chosen.otherwise(F.lit("other"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(df: DataFrame) -> DataFrame:
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    pairs = as_text.unpivot([], as_text.columns, "column_name", "value")
    return pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _types(df: DataFrame, name: Column) -> Column:
    chosen = F.when(F.lit(False), F.lit(""))
    for field in df.schema.fields:
        chosen = chosen.when(name == field.name, F.lit(field.dataType.simpleString()))
    return chosen


def profile_columns(df: DataFrame, samples: int = 5) -> DataFrame:
    """Type, role, null, value and distinct counts and the smallest sample values of every column."""
    counts = _pairs(df)
    present = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    stats = counts.groupBy("column_name").agg(
        F.sum(present).alias("non_null_count"),
        F.sum(F.col("n") - present).alias("null_count"),
        F.count("value").alias("unique_count"),
    )
    # Written so that both branches read the same shuffle: same columns, no filter that would move below it.
    first = F.row_number().over(W.partitionBy("column_name").orderBy(F.col("value").asc_nulls_last()))
    sampled = (
        counts.where(F.col("n") > 0)
        .withColumn("_rank", first)
        .where(F.col("_rank") <= samples)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("_values"))
        .select("column_name", F.when(F.size("_values") > 0, F.array_join("_values", " | ")).alias("sample_values"))
    )
    return (
        stats.join(sampled, "column_name", "left")
        .withColumn("data_type", _types(df, F.col("column_name")))
        .withColumn("role", role_column(F.col("column_name")))
    )


def profile_columns_approx(df: DataFrame, log2_size: int = 12) -> DataFrame:
    """Null and approximate distinct counts in one pass that shuffles one small sketch per column and task."""
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for c, kind in df.dtypes:
        value = F.col(c) if kind in ("int", "bigint", "string", "binary") else F.col(c).cast("string")
        aggregates.append(F.count(c).alias(f"{c}__count"))
        aggregates.append(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(log2_size))).alias(f"{c}__distinct"))
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__count").alias("non_null_count"),
            (F.col("__rows") - F.col(f"{c}__count")).alias("null_count"),
            F.col(f"{c}__distinct").alias("unique_count"),
        )
        for c in df.columns
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*per_column)))


def structure_profile(df: DataFrame) -> DataFrame:
    """Type, nullable and unique per column, over all rows."""
    stats = _pairs(df).groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("_nulls"),
        F.max("n").alias("_most"),
    )
    return stats.select(
        "column_name",
        _types(df, F.col("column_name")).alias("data_type"),
        (F.col("_nulls") > 0).alias("has_nulls"),
        ((F.col("_nulls") == 0) & (F.col("_most") == 1)).alias("is_unique"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and emptiness of every column, in one pass without a data shuffle."""
    one_row = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns]
    )
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col("__rows") - F.col(c)).alias("null_count"),
            (F.col(c) > 0).alias("has_data"),
        )
        for c in df.columns
    ]
    return one_row.select(F.inline(F.array(*per_column)))


def most_nulls(df: DataFrame, k: int = 10) -> DataFrame:
    return null_profile(df).orderBy(F.col("null_count").desc(), F.col("column_name")).limit(k)


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Earliest, latest and number of valid dates per date column; text that is no date does not count."""
    parsed = df.select(*[F.col(c).try_cast("timestamp_ntz").alias(c) for c in columns])
    one_row = parsed.agg(
        *[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("n", F.count))]
    )
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__min").alias("earliest"),
            F.col(f"{c}__max").alias("latest"),
            F.col(f"{c}__n").alias("total_dates"),
        )
        for c in columns
    ]
    return one_row.select(F.inline(F.array(*per_column))).where(F.col("total_dates") > 0)


def text_profile(df: DataFrame, column: str, order: str, samples: int = 3) -> DataFrame:
    """Mean length of a text column beside its first texts."""
    mean = df.agg(F.round(F.avg(F.length(column)), 6)).scalar()
    first = df.where(F.col(column).isNotNull()).orderBy(order).limit(samples)
    return first.select(order, F.col(column).alias("sample"), mean.alias("avg_length"))


def column_overlap(records: DataFrame, file: str, columns: Column) -> DataFrame:
    """In how many files each record column occurs; ``columns`` is an array of the names of one record."""
    pairs = records.select(F.col(file).alias("file"), F.explode(columns).alias("column_name")).distinct()
    files = records.agg(F.countDistinct(file)).scalar()
    counted = pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("frequency"))
    return counted.select(
        "column_name",
        "frequency",
        (F.col("frequency") > files * COMMON_SHARE).alias("is_common"),
        (F.col("frequency") <= RARE_FILES).alias("is_rare"),
        (F.col("frequency") == 1).alias("is_unique"),
    )


def file_inventory(df: DataFrame) -> DataFrame:
    """Rows, columns and size of every file of a scan."""
    return (
        df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("file", "bytes")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("column_count", F.lit(len(df.columns)))
        .withColumn("size_mb", F.round(F.col("bytes") / (1024 * 1024), 4))
    )
