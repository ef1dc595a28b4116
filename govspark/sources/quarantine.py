"""Envelopes with what is damaged kept aside: good items and rejected pieces from one pass, counted while it runs.

A line that is no envelope, and an element that is no object or does not fit the item's type, becomes a rejected row with its
file, its text and the reason. Nothing is dropped: of every file, good and rejected rows together are what was read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE, ELEMENT, TYPE = "no envelope", "no object", "wrong type"


@dataclass
class Checked:
    """``good``: file, network and the item's columns; ``rejected``: file, network, reason, text; ``counts``: read, good, rejected."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]

    def by_file(self) -> DataFrame:
        """(file, good, rejected)."""
        both = self.good.select("file", F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(self.rejected.select("file", F.lit(0).alias("g"), F.lit(1).alias("r")))
        return both.groupBy("file").agg(F.sum("g").alias("good"), F.sum("r").alias("rejected"))


def checked_rows(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(file, network, item, reason, text): one row per element, and per line that is no envelope. ``item`` is a struct type."""
    kind = T.StructType.fromDDL(f"x {item}")["x"].dataType
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    network, items = F.try_variant_get("v", "$.network", "string"), F.try_variant_get("v", "$.items", "array<variant>")
    listed = parsed.select("file", "value", network.alias("network"), items.alias("items"))
    each = listed.select("file", "network", F.when(F.col("items").isNull(), F.col("value")).alias("line"), F.explode_outer("items").alias("element"))
    is_object = F.coalesce(F.schema_of_variant("element").startswith("OBJECT<"), F.lit(False))
    # a value that is there but does not fit its type makes the element a rejected one
    fields, fits = [], F.lit(True)
    for f in kind.fields:
        at = "$[" + repr(f.name) + "]"
        raw, value = F.try_variant_get("element", at, "variant"), F.try_variant_get("element", at, f.dataType.simpleString())
        fits = fits & (raw.isNull() | F.is_variant_null(raw) | value.isNotNull())
        fields.append(value.alias(f.name))
    empty = F.col("line").isNull() & F.col("element").isNull()  # an envelope without items
    reason = F.when(F.col("line").isNotNull(), LINE).when(~is_object, ELEMENT).when(~fits, TYPE)
    kept = each.where(~empty).withColumn("reason", reason)
    good = F.when(F.col("reason").isNull(), F.struct(*fields))
    text = F.when(F.col("reason").isNotNull(), F.coalesce("line", F.to_json("element")))
    return kept.select("file", "network", good.alias("item"), "reason", text.alias("text"))


def load_checked(spark: SparkSession, path: str, item: str, target: str) -> Checked:
    """Reads the lines once and writes good and rejected rows side by side under ``target``."""
    seen = Observation()
    rows = checked_rows(spark, path, item).observe(
        seen, F.count("*").alias("read"), F.count(F.when(F.col("reason").isNull(), 1)).alias("good"), F.count("reason").alias("rejected")
    )
    rows.withColumn("is_good", F.col("reason").isNull()).write.mode("overwrite").partitionBy("is_good").parquet(target)
    schema = T.StructType([*rows.schema.fields, T.StructField("is_good", T.BooleanType())])
    stored = spark.read.schema(schema).parquet(target)
    good = stored.where("is_good").select("file", "network", "item.*")
    return Checked(good, stored.where("NOT is_good").select("file", "network", "reason", "text"), seen.get)
