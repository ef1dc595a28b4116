"""From raw documents to token ids: quality, near duplicates, repeated spans, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but
the last return the columns of ``documents``. A row without a key goes through all stages unjudged and uncut.
There is no SQL twin: two stages cannot be said in SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm import bpe, decontamination, jaccard_join, quality, substring_dedup
from govspark.scratch import settle
from govspark.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-training does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate component."""
    return jaccard_join.keep_first(docs)


def repeated_span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier document has; n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = substring_dedup.cut(docs, carry=others).withColumnRenamed("kept", "text")
    if "n_chars" in others:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number, and a digest of what the ids decode to."""
    return bpe.encode_verified(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), kept=("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_spans", repeated_span_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
