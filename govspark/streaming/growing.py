"""Loads whose records gain fields, and whose fields change their type, from one load to the next.

Landed records are JSON lines of any shape. Every batch finds the schema of its records and merges it with the stored one; if
that grows, a new version is stored, and parts written from then on lie under it. Nothing written is touched again: a
reader takes every version with its own schema and widens it to the last. Whole numbers and decimals widen to a decimal
that holds both; other types that differ become ``variant``, which keeps each value as it was written. A line that is no
JSON object goes to the rejected rows of the target.

A target holds ``_versions/`` (schemas), ``_rows/_version=/_load=/_batch=`` and ``_rejected/_load=/_batch=``. A batch that
is run again finds its own schema merged already and replaces its own parts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.operators.joins import new_records_of_small_batch
from govspark.scratch import settle
from govspark.streaming.incremental import load_id

VERSION, LOAD, BATCH = "_version", "_load", "_batch"
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds all values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        known = {f.name: f.dataType for f in b.fields}
        both = [T.StructField(f.name, merge(f.dataType, known.get(f.name, f.dataType))) for f in a.fields]
        return T.StructType(both + [f for f in b.fields if f.name not in a.names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge(a.elementType, b.elementType))
    exact = [_exact(t) for t in (a, b)]
    if all(exact):
        whole, scale = (max(x) for x in zip(*exact))
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    return T.VariantType()


def _exact(kind: T.DataType) -> tuple[int, int] | None:
    """(digits before the point, digits behind it)."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return (_DIGITS[type(kind)], 0) if type(kind) in _DIGITS else None


def found_schema(records: DataFrame, value: str = "v") -> T.StructType:
    """The merged schema of all objects in a variant column, found in one pass; nulls alone make no field."""
    text = records.agg(F.schema_of_variant_agg(value)).first()[0]
    if text is None or not text.startswith("OBJECT<"):
        return T.StructType([])
    return _without_nulls(T.StructType.fromDDL("r " + text.replace("OBJECT<", "STRUCT<"))["r"].dataType)


def _without_nulls(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, _without_nulls(f.dataType)) for f in kind.fields]
        return T.StructType([f for f in fields if not isinstance(f.dataType, T.NullType)]) if fields else T.VariantType()
    if isinstance(kind, T.ArrayType):
        element = _without_nulls(kind.elementType)
        return T.ArrayType(T.VariantType() if isinstance(element, T.NullType) else element)
    return kind


def versions(spark: SparkSession, target: str) -> dict[int, T.StructType]:
    try:
        rows = spark.read.option("recursiveFileLookup", True).text(f"{target}/_versions").collect()
    except AnalysisException:
        return {}
    return {int(n): T.StructType.fromJson(json.loads(text)) for n, text in (r["value"].split("\t", 1) for r in rows)}


def _grow(spark: SparkSession, target: str, found: T.StructType) -> tuple[int, T.StructType]:
    """The version that holds the found schema; stored first if it is new."""
    known = versions(spark, target)
    last = max(known, default=0)
    merged = merge(known[last], found) if known else found
    if known and merged == known[last]:
        return last, merged
    text = f"{last + 1}\t{merged.json()}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_versions/{last + 1}")
    return last + 1, merged


def widen(value: Column, own: T.DataType, wanted: T.DataType) -> Column:
    """A value of one version as the type of a later one."""
    if own == wanted:
        return value
    if isinstance(wanted, T.VariantType):
        return F.to_variant_object(value) if isinstance(own, (T.StructType, T.ArrayType)) else value.cast("variant")
    if isinstance(wanted, T.StructType):
        fields = [
            (widen(value[f.name], own[f.name].dataType, f.dataType) if f.name in own.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: widen(x, own.elementType, wanted.elementType))
    return value.cast(wanted)


def read_growing(spark: SparkSession, target: str) -> DataFrame:
    """All rows under the last schema; fields that a row's version did not have are null."""
    known = versions(spark, target)
    if not known:
        return spark.createDataFrame([], f"{LOAD} string, {BATCH} long")
    wanted = known[max(known)]
    parts = []
    for number, own in sorted(known.items()):
        stored = T.StructType([*own.fields, T.StructField(LOAD, T.StringType()), T.StructField(BATCH, T.LongType())])
        try:
            rows = spark.read.schema(stored).parquet(f"{target}/_rows/{VERSION}={number}")
        except AnalysisException:  # a version whose batch was not written
            continue
        columns = [
            widen(F.col(f"`{f.name}`"), own[f.name].dataType, f.dataType).alias(f.name) if f.name in own.names else F.lit(None).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
        parts.append(rows.select(*columns, LOAD, BATCH))
    if not parts:
        return spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField(LOAD, T.StringType()), T.StructField(BATCH, T.LongType())]))
    return reduce(DataFrame.unionByName, parts)


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """(value, _load, _batch): lines that are no JSON object."""
    try:
        return spark.read.schema(f"value string, {LOAD} string, {BATCH} long").parquet(f"{target}/_rejected")
    except AnalysisException:
        return spark.createDataFrame([], f"value string, {LOAD} string, {BATCH} long")


def append_growing(lines: DataFrame, batch_id: int, target: str, key: str | None = None, load: str = "load") -> None:
    """Writes a batch of JSON lines (value). With a key only records whose key is new to the target are kept."""
    spark = lines.sparkSession
    parsed = settle(lines.select("value", F.try_parse_json("value").alias("v")).withColumn("good", F.schema_of_variant("v").startswith("OBJECT<")), "landed")
    bad = parsed.where(F.col("good").isNull() | ~F.col("good")).select("value")
    bad.write.mode("overwrite").parquet(f"{target}/_rejected/{LOAD}={load}/{BATCH}={batch_id}")
    good = parsed.where("good")
    number, schema = _grow(spark, target, found_schema(good))
    if not schema.fields:
        return
    rows = good.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if key is not None:
        known = read_growing(spark, target).where((F.col(LOAD) != load) | (F.col(BATCH) != batch_id))
        text = lambda df: df.withColumn("_key", _as_text(F.col(f"`{key}`"), df.schema[key].dataType))
        fresh = text(rows).where(F.col("_key").isNotNull()).dropDuplicates(["_key"])
        rows = new_records_of_small_batch(fresh, text(known).select("_key"), "_key").drop("_key")
    rows.write.mode("overwrite").parquet(f"{target}/_rows/{VERSION}={number}/{LOAD}={load}/{BATCH}={batch_id}")


def _as_text(value: Column, kind: T.DataType) -> Column:
    """A key's text, which stays when its type widens."""
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(value, "$", "string")
    return F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1") if isinstance(kind, T.DecimalType) else value.cast("string")


def growing_load(spark: SparkSession, landing: str, target: str, checkpoint: str, key: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Loads all files of JSON lines that have landed since the last run under this checkpoint; the target's rows."""
    load = load_id(spark, checkpoint)
    landed = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing)
    run = (
        landed.writeStream.foreachBatch(lambda batch, batch_id: append_growing(batch, batch_id, target, key, load))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return read_growing(spark, target).drop(LOAD, BATCH)
