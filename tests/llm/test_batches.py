"""What an executor and its Python workers hold of the texts at once is bounded, whatever a file's row groups are."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from govspark.llm import bpe, jaccard_join, quality, substring_dedup, words


@pytest.fixture
def session(spark):
    """A session of its own, as the settings of the shared one may be set by now."""
    return spark.newSession()


def table(session, rows=400, n_words=2500):
    rng = random.Random(5)
    body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n_words)) for _ in range(rows // 2)] * 2
    docs = [(i, text, "en", "web", len(text)) for i, text in enumerate(body)]
    return session.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def watch(monkeypatch, kind, most):
    plain = kind.mapInArrow

    def mapped(self, run, schema, *args, **kwargs):
        def bounded(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes <= most or batch.num_rows == 1, f"{batch.nbytes} bytes at once"
                    yield batch

            return run(seen())

        return plain(self, bounded, schema, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", mapped)


def test_workers_get_texts_in_small_batches(session, monkeypatch):
    docs = table(session)
    watch(monkeypatch, type(docs), 2 * words.PART_BYTES)
    labels = session.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert quality.score(docs, labels).count() == 400
    assert jaccard_join.keep_first(docs).count() == 200
    assert substring_dedup.cut(docs).filter("n_removed > 0").count() == 200
    assert bpe.encode_verified(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).filter("n_tokens > 0").count() == 400


def test_a_setting_of_the_session_stays(session):
    session.conf.set(words.BATCH_BYTES, "123456")
    jaccard_join.similarity_components(session.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert session.conf.get(words.BATCH_BYTES) == "123456"


def test_numbers_of_a_batch_take_little_memory(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc long, body string")
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run) or self)
    jaccard_join._hash_block(docs, 5, 80)
    rng = random.Random(6)
    body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(250)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(body)], names=["doc", "body"])
    tracemalloc.start()
    rows = sum(part.num_rows for part in found[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 800 and peak < 24 << 20, f"{peak >> 20} MB"
