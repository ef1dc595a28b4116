"""Names and keys."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the columns whose values make up the key of a record.
RECORD_KEY = ["source_network", "source_proposal_type", "index", "onchaininfo_hash"]


def sanitize_key(key: Column) -> Column:
    """Lower case, letters, digits and single underscores only."""
    return F.lower(F.btrim(F.regexp_replace(key, "[^0-9a-zA-Z]+", "_"), F.lit("_")))


def sanitize_name(key: str) -> str:
    return re.sub("[^0-9a-zA-Z]+", "_", key).strip("_").lower()


def clean_column(name: Column) -> Column:
    """Blanks, dashes and dots become single underscores; a leading digit gets a prefix."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(name, "[ .-]", "_"), "_+", "_"), F.lit("_"))
    return F.lower(F.when(clean.rlike("^[0-9]"), F.concat(F.lit("col_"), clean)).otherwise(clean))


def clean_name(name: str) -> str:
    clean = re.sub("_+", "_", re.sub("[ .-]", "_", name)).strip("_").lower()
    return f"col_{clean}" if clean[:1].isdigit() else clean


def rename_clean(df: DataFrame) -> DataFrame:
    """All columns under their clean names; two columns of one clean name are an error."""
    names = [clean_name(c) for c in df.columns]
    twice = [n for n, times in Counter(names).items() if times > 1]
    if twice:
        raise ValueError(f"columns collide after cleaning: {twice}")
    return df.toDF(*names)


def composite_key(df: DataFrame, columns: list[str], separator: str = "_") -> Column:
    """Values joined by ``separator``; missing values and missing columns count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns]
    return F.concat_ws(separator, *parts)
