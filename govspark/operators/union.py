"""Unions of tables with different columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE_COLUMNS = ["source_file", "source_network", "source_proposal_type", "source_row_id"]


def column_order(columns: list[str]) -> list[str]:
    """Source tracking columns first, all others by name."""
    present = set(columns)
    return [c for c in SOURCE_COLUMNS if c in present] + sorted(present - set(SOURCE_COLUMNS))


def union_merge_schema(*tables: DataFrame) -> DataFrame:
    """UNION ALL over the union of the columns; missing ones are null.

    Meant for a handful of tables. Many files of one kind are read in one scan with a merged schema instead.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return merged.select(*column_order(merged.columns))


def union_results(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several questions in one table, labelled by question."""
    labelled = [rows.withColumn("question", F.lit(name)) for name, rows in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def project_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def project_lenient(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The available ones of these columns, with the missing and the extra column names."""
    wanted = list(dict.fromkeys(columns))
    missing = [c for c in wanted if c not in df.columns]
    extra = [c for c in df.columns if c not in wanted]
    return df.select(*[c for c in wanted if c in df.columns]), missing, extra
