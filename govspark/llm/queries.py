"""The named queries of the operators, over their whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm import (
    bpe,
    decontamination,
    hnsw,
    jaccard_join,
    language_id,
    language_model,
    license_scan,
    quality,
    sharding,
    spelling,
    substring_dedup,
    tokenizer_alignment,
    url_templates,
)
from govspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register
def op2_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(table(spark, sf_dir, "documents"), texts=False)


@register
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"))


@register
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_10 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op10_benchmark_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS_10} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
length AS (SELECT DISTINCT len(p) AS k FROM phrase),
doc AS (SELECT doc_id, {_WORDS_10} AS w FROM documents),
place AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, length WHERE len(w) >= k)
),
match AS (SELECT DISTINCT doc_id, i, k, item_id FROM place JOIN phrase USING (p)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(k)) AS j FROM match) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM match) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@register
def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


ORACLES["op4_url_templates"] = url_templates.ORACLE


@register
def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs)


@register
def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))
    joined = [F.array_join(c, ",").alias(c) for c in ("text_licenses", "line_licenses")]
    return found.select("doc_id", "digest", *joined)


ORACLES["op6_license_digests"] = license_scan.oracle()


@register
def op8_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@register
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    found = language_model.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@register
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), a, b)


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(spelling.vocabulary(table(spark, sf_dir, "documents"), slip=97))


@register
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = language_id.predict(docs, language_id.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
