"""From landed JSON files to loaded tables, as one lazy chain without files in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.functions import coerce, keys, links
from govspark.functions.amounts import conviction_weighted
from govspark.operators.flatten import flatten_wide, parse_records, record_schema
from govspark.operators.joins import new_records_of_small_batch
from govspark.operators.ordered import positions
from govspark.operators.union import project_lenient
from govspark.schemas import CURATED_COLUMNS, VOTE_FIELDS


def raw_items(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Items of envelope files as JSON text, with their file and their place in it.

    Files may differ in schema: items stay text until all files are known. ``whole_files`` reads one envelope per file,
    otherwise one per line.
    """
    read = spark.read.text(path, wholetext=whole_files)
    envelopes = read.select(F.col("_metadata.file_name").alias("source_file"), F.try_parse_json("value").alias("envelope"))
    listed = envelopes.withColumn("items", F.try_variant_get("envelope", "$.items", "variant")).where(F.col("items").isNotNull())
    exploded = listed.lateralJoin(spark.tvf.variant_explode(F.col("items").outer()).toDF("pos", "key", "item"))
    return exploded.select("source_file", "pos", F.to_json("item").alias("item"))


def wide_table(items: DataFrame, schema: str | None = None, max_array: int | None = None) -> DataFrame:
    """All items in one wide table: a merged schema instead of a union of one table per file.

    ``items`` has source_file, pos and item. The schema is found in one pass over the items unless it is given. Source
    columns come first, the others by name, the record key last.
    """
    # The place in the file numbers the rows of a file that holds one envelope.
    numbered = items.withColumn("source_row_id", F.col("pos").cast("bigint") + 1)
    parsed = parse_records(numbered, "item", schema or record_schema(items, "item"))
    source = ["source_file", "source_network", "source_proposal_type", "source_row_id"]
    tracked = parsed.select(
        "source_file",
        links.file_network(F.regexp_replace("source_file", r"\.json$", "")).alias("source_network"),
        links.file_proposal_type(F.regexp_replace("source_file", r"\.json$", "")).alias("source_proposal_type"),
        "source_row_id",
        *[c for c in parsed.columns if c not in ("source_file", "source_row_id", "pos", "item")],
        "item.*",
    )
    flat = flatten_wide(tracked, max_array, on_collision="last")
    ordered = flat.select(*source, *sorted(c for c in flat.columns if c not in source))
    return ordered.withColumn("row_index", keys.composite_key(ordered, keys.RECORD_KEY))


def number_rows(rows: DataFrame, file: str, order: list[str]) -> DataFrame:
    """1-based row number per file, for files of many envelopes."""
    return positions(rows, [file], order, "source_row_id")


def curated(wide: DataFrame, types: dict[str, str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """The curated columns that exist, typed; beside them the missing and the extra column names."""
    kept, missing, extra = project_lenient(wide, CURATED_COLUMNS)
    return coerce.apply_schema(kept, types or {}), missing, extra


def new_rows(curated_rows: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose record key the target lacks."""
    return new_records_of_small_batch(curated_rows, target, "row_index")


def flat_votes(records: DataFrame, record: str = "element") -> DataFrame:
    """Vote records as flat rows; nested values as JSON text, the balance weighted by its lock period."""

    def text_at(path: str) -> Column:
        value = F.try_variant_get(record, f"$.{path}", "variant")
        text = F.to_json(value)
        return F.when(F.left(text, F.lit(1)).isin("{", "["), text).otherwise(value.try_cast("string"))

    columns = {path.replace(".", "_"): text_at(path) for path in VOTE_FIELDS}
    columns["balance_value"] = conviction_weighted(text_at("balance.value"), text_at("lockPeriod"))
    flat = records.select(*[value.alias(name) for name, value in columns.items()])
    return flat.withColumn("index_voterAddress", keys.composite_key(flat, ["postDetails_index", "voterAddress"]))
