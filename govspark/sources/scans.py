"""Scans of JSON, CSV and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How text survives CSV: all of it quoted, a doubled quote inside, nothing trimmed, a null as a bare \\N.
CSV = {
    "header": "true", "quoteAll": "true", "escape": '"', "emptyValue": "", "nullValue": "\\N", "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}

ENVELOPE = "network string, timestamp string, total_items int, items array<{item}>"


def scan_envelopes(spark: SparkSession, path: str, item: str, multi_line: bool = True) -> DataFrame:
    """Items of {network, timestamp, total_items, items[]} files; files without items yield nothing.

    ``item`` is the type of one item, for example ``struct<id:bigint,title:string>``. Files hold one record
    each, indented or not; ``multi_line=False`` reads files of one record per line, which Spark can split. A damaged file
    gives nothing here and shows in ``file_report``.
    """
    read = spark.read.schema(ENVELOPE.format(item=item)).option("multiLine", multi_line)
    records = read.json(path).select("network", F.explode("items").alias("item"))
    return records.select("network", "item.*")


def file_report(spark: SparkSession, path: str, item: str, multi_line: bool = True) -> DataFrame:
    """Per file: items read, damaged records and whether the file counts as processed."""
    schema = T.StructType.fromDDL(ENVELOPE.format(item=item)).add("_corrupt_record", "string")
    records = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)
    per_record = records.select(
        F.col("_metadata.file_path").alias("file"),
        F.coalesce(F.size("items"), F.lit(0)).alias("n"),
        F.col("_corrupt_record").isNotNull().alias("bad"),
    )
    counted = per_record.groupBy("file").agg(
        F.sum(F.greatest(F.col("n"), F.lit(0))).alias("items"), F.count(F.when(F.col("bad"), 1)).alias("damaged")
    )
    return counted.withColumn("success", (F.col("items") > 0) & (F.col("damaged") == 0)).withColumn(
        "message",
        F.when(F.col("damaged") > 0, "Damaged record").when(F.col("items") == 0, "No items found")
        .otherwise(F.concat(F.lit("Processed "), F.col("items").cast("string"), F.lit(" rows"))),
    )


def _documents(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    read = spark.read.text(path, wholetext=whole_files)
    return read.select(F.try_parse_json("value").alias("doc")).where(F.col("doc").isNotNull())


def _elements(documents: DataFrame, listed) -> DataFrame:
    """Elements of the lists in ``listed``; the outer form is not wanted, an empty list has none."""
    spark = documents.sparkSession
    with_list = documents.withColumn("listed", listed)
    exploded = with_list.lateralJoin(spark.tvf.variant_explode(F.col("listed").outer()).toDF("pos", "key", "element"))
    return exploded.select("element")


def scan_list_or_object(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """JSON documents, one per file or one per line: lists give their elements, objects themselves, damaged ones none."""
    documents = _documents(spark, path, whole_files)
    is_list = F.schema_of_variant("doc").startswith("ARRAY")
    in_list = F.when(is_list, F.col("doc")).otherwise(F.parse_json(F.concat(F.lit("["), F.to_json("doc"), F.lit("]"))))
    return _elements(documents, in_list)


def scan_votes(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Vote records from documents that are a list or an object with ``items``."""
    documents = _documents(spark, path, whole_files)
    return _elements(documents, F.coalesce(F.try_variant_get("doc", "$.items", "variant"), F.col("doc")))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header, as ``write_csv`` writes it, under a declared schema; inference would read the data twice.

    Line breaks, quotes and blanks in text come back as they were; an empty text and a null stay apart.
    """
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder tree: folder, stem, extension and whole text."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return files.select(
        F.element_at(F.split(name, "/"), -2).alias("folder"),
        F.regexp_extract(name, r"([^/]+)\.[^./]*$", 1).alias("stem"),
        F.regexp_extract(name, r"\.([^./]*)$", 1).alias("extension"),
        F.col("value").alias("text"),
    )
