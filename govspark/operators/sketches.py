"""Column profiles from small sketches per file, which are stored and merged: a new file costs itself only.

A file's row for a column holds exact counts, least and greatest value, a sketch of its distinct values (HLL) and, of numbers,
one of its quantiles (KLL). Sketches of any files merge to what one pass over all of them gives, within the error that the
same sketch has there: about 1.04 / sqrt(2^LOG2) of the distinct values, and about 1.65 % of the rows for a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG2 = 12
QUANTILES = (0.25, 0.5, 0.75)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _numeric(kind: str) -> bool:
    return kind.split("(")[0] in NUMERIC


def file_sketches(rows: DataFrame, file: Column) -> DataFrame:
    """(file, column_name, rows, non_null, least, greatest, distinct, quantiles) in one pass over all columns."""
    aggregates = [F.count("*").alias("rows")]
    for i, (name, kind) in enumerate(rows.dtypes):
        value = F.col(f"`{name}`")
        text = value.cast("string")
        number = value.cast("double") if _numeric(kind) else F.lit(None).cast("double")
        aggregates += [
            F.count(value).alias(f"n{i}"), F.min(value).cast("string").alias(f"l{i}"), F.max(value).cast("string").alias(f"g{i}"),
            F.hll_sketch_agg(text, F.lit(LOG2)).alias(f"d{i}"), F.kll_sketch_agg_double(F.when(~F.isnan(number), number)).alias(f"q{i}"),
        ]
    grouped = rows.groupBy(file.alias("_file")).agg(*aggregates)
    each = [
        F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"), "rows", F.col(f"n{i}").alias("non_null"), F.col(f"l{i}").alias("least"),
                 F.col(f"g{i}").alias("greatest"), F.col(f"d{i}").alias("distinct"), F.col(f"q{i}").alias("quantiles"))
        for i, (name, kind) in enumerate(rows.dtypes)
    ]
    return grouped.select(F.col("_file").alias("file"), F.inline(F.array(*each)))


def add_files(rows: DataFrame, file: Column, path: str, load: str) -> None:
    """Stores the sketches of a load's files; the same load again replaces its own."""
    file_sketches(rows, file).write.mode("overwrite").parquet(f"{path}/load={load}")


def merged_profile(spark: SparkSession, path: str) -> DataFrame:
    """(column_name, files, rows, null_count, least, greatest, distinct, q25, q50, q75) over all stored files.

    Least and greatest values are compared as numbers where the column holds numbers.
    """
    stored = spark.read.parquet(path)
    numeric = F.col("data_type").rlike("^(" + "|".join(NUMERIC) + ")")
    ends = [
        F.coalesce(f(F.when(numeric, F.col(c).cast("double"))).cast("string"), f(F.when(~numeric, F.col(c)))).alias(c)
        for f, c in ((F.min, "least"), (F.max, "greatest"))
    ]
    merged = stored.groupBy("column_name").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("non_null")).alias("null_count"), *ends,
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("q"),
        F.max(numeric & (F.col("non_null") > 0)).alias("numeric"),
    )
    cuts = [F.when(F.col("numeric"), F.kll_sketch_get_quantile_double("q", F.lit(x))).alias(f"q{round(x * 100)}") for x in QUANTILES]
    return merged.select("column_name", "files", "rows", "null_count", "least", "greatest", "distinct", *cuts)
