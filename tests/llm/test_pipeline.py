"""The whole pipeline against brute force, from the documents that the quality stage keeps."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from govspark.llm import quality
from govspark.sources.tables import table
from tests.llm import test_decontamination, test_jaccard_join, test_substring_dedup


def cut_text(words_and_spaces, gone):
    """Removed words go with the white space behind them."""
    out = [w + (s if i + 1 < len(words_and_spaces) else "") for i, (w, s) in enumerate(words_and_spaces) if i not in gone]
    return "".join(out).rstrip()


def removed(rows, width=13):
    words = {d: test_substring_dedup.WORD.findall(t or "") for d, t in rows}
    first, out = {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    for d, w in words.items():
        out[d] = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
    return out


def split_spaces(text):
    import re

    return re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text)


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in quality.keep_good(docs, table(spark, sf_dir, "labels")).collect())
    assert 0.7 * docs.count() < len(rows) < docs.count()
    first = {d: c for d, _, c in test_jaccard_join.brute(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    gone = removed(rows)
    rows = [(d, cut_text(split_spaces(t), gone[d]) if gone[d] else t) for d, t in rows]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {d: n for d, _, n, _ in test_decontamination.brute(rows, items, 10)}
    rows = [(d, t) for d, t in rows if not hit[d]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((d, encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.tokens, r.decoded_sha256) for r in got) == expected
    assert all(r.n_tokens == len(r.tokens) for r in got)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_keep_rows_without_a_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leak = table(spark, sf_dir, "benchmark").filter("length(text) > 0").select("text")
    texts = leak.unionByName(docs.filter("length(text) > 0").select("text").limit(3)).limit(5)
    loose = texts.unionByName(texts).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    loose = spark.createDataFrame(loose.collect() + [(None, None, "en", "s", None)], docs.select(*loose.columns).schema)
    few = docs.select(*loose.columns).limit(40).unionByName(loose)
    expected = sorted(map(repr, loose.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(repr, stage(spark, few, sf_dir).filter("doc_id IS NULL").collect())) == expected, name


def test_stages_take_empty_tables_and_clashing_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = ("doc", "body", "n", "gram", "kept_0", "score", "component_id", "n_hit", "term", "y")
    wide = docs.limit(25).selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in names))
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0, name
        found = stage(spark, wide, sf_dir)
        assert found.count() > 0, name
        if name != "tokens":
            assert none.columns == docs.columns and found.columns == wide.columns, name
            assert all(r[c] == f"{c}{r.doc_id}" for r in found.collect() for c in names), name
