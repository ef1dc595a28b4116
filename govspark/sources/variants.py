"""Records kept as variants whose fields lie in columns of their own.

JSON text is parsed once, when records are stored. Spark infers the fields that most records share and stores each as a typed
column beside the rest; a dotted path then reads its own column, and a comparison with it skips row groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What has to be on for variants to be stored and read by their fields.
SETTINGS = ("writeShredding.enabled", "inferShreddingSchema", "allowReadingShredded", "pushVariantIntoScan")


@contextmanager
def shredding(spark: SparkSession) -> Iterator[None]:
    """These settings for what is written or planned inside; the session's own come back afterwards."""
    names = [f"spark.sql.variant.{name}" for name in SETTINGS]
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def store_records(lines: DataFrame, path: str, value: str = "value", keys: list[str] | None = None) -> None:
    """Writes (keys, record) of JSON texts; a text that is no JSON, and a missing one, has a null record."""
    with shredding(lines.sparkSession):
        lines.select(*(keys or []), F.try_parse_json(value).alias("record")).write.mode("overwrite").parquet(path)


def at(dotted: str, kind: str = "string", record: str = "record") -> Column:
    """The value at a dotted path as a type, null where the path or such a value is missing."""
    path = "$" + "".join("[" + step + "]" if step.isdigit() else "['" + step.replace("'", "\\'") + "']" for step in dotted.split("."))
    return F.try_variant_get(record, path, kind)


def as_text(dotted: str, record: str = "record") -> Column:
    """A plain value as its text, a nested one as JSON."""
    nested = at(dotted, "variant", record)
    return F.coalesce(at(dotted, "string", record), F.when(~F.is_variant_null(nested), F.to_json(nested)))


def fields(records: DataFrame, wanted: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """A column for each dotted path with its type; ``json`` stands for text of any value."""
    columns = [(as_text(path) if kind == "json" else at(path, kind)).alias(path.replace(".", "_")) for path, kind in wanted.items()]
    return records.select(*(keep or []), *columns)
