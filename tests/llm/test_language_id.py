from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from govspark.llm import language_id
from govspark.llm.words import mix


def held_out(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


def test_features_against_single_texts():
    rows = ["", None, "a", "Ab c", "Straße 漢字!", "x" * 300, "é"]
    found, bounds = language_id.features(pa.array(rows))
    for i, text in enumerate(rows):
        signs = [0 if ord(c) < 128 and not c.isalpha() else ord(c) for c in (text or "").lower()]
        expected = []
        for width in range(language_id.WIDTHS):
            for at in range(len(signs) - width):
                h = 0
                for code in signs[at : at + width + 1]:
                    h = (h * int(language_id._STEP) + code + 1) % (1 << 64)
                expected.append(int(mix(np.array([(h + width) % (1 << 64)], np.uint64))[0]) >> (64 - language_id.BITS))
        assert found[bounds[i] : bounds[i + 1]].tolist() == expected


def test_document_frequencies(spark):
    rows = ["aaa", "aab", "", "b b", "aaa"]
    df, n = language_id._document_frequencies(spark.createDataFrame([(t,) for t in rows], "body string").repartition(3))
    expected = np.zeros(1 << language_id.BITS, np.int64)
    for text in rows:
        expected[np.unique(language_id.features(pa.array([text]))[0])] += 1
    assert n == 5 and (df == expected).all()


def test_leader_follows_the_published_update():
    leader = language_id.Leader.start(3)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    rng = np.random.default_rng(1)
    for _ in range(30):
        at, x, label = np.array([0, 2, 5]), rng.normal(size=3), int(rng.integers(3))
        w = np.zeros((6, 3))
        for i in range(6):
            for k in range(3):
                if abs(z[i, k]) > language_id.L1:
                    w[i, k] = -(z[i, k] - np.sign(z[i, k]) * language_id.L1) / ((language_id.BETA + n[i, k] ** 0.5) / language_id.ALPHA + language_id.L2)
        p = np.exp(x @ w[at])
        p /= p.sum()
        for j, i in enumerate(at):
            for k in range(3):
                g = (p[k] - (k == label)) * x[j]
                sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / language_id.ALPHA
                z[i, k] += g - sigma * w[i, k]
                n[i, k] += g * g
        leader.learn(at, x, label)
    assert np.allclose(leader.z[:6], z) and np.allclose(leader.n[:6], n)
    leader.z[7] = language_id.L1 / 2
    assert (leader.weights()[7] == 0).all()


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    from govspark.llm import queries

    return queries.QUERIES["op13_language_id"](spark, sf_dir).collect()


def test_held_out_accuracy(spark, sf_dir, found):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in unseen) >= 0.97 * len(unseen)
    # scores are calibrated: their mean is about the share of right ones
    assert abs(np.mean([r.score for r in unseen]) - np.mean([truth[r.doc_id] == r.lang_pred for r in unseen])) < 0.05


def test_only_learnable_rows_and_texts_count(spark):
    texts = {"aa": "abba baab aba bab " * 5, "xx": "xyyx yxxy xyx yxy " * 5}
    rows = [(i, texts["aa" if i % 2 else "xx"] + "ab"[i % 2] * (i % 7), "aa" if i % 2 else "xx") for i in range(200)]
    rows += [(None, texts["aa"], "aa"), (7, None, "aa"), (8, "", "xx"), (9, "123 !?", "xx"), (10, texts["xx"] * 2000, None), (1, texts["aa"], "aa")]
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(df)
    assert model.languages == ["aa", "xx"] and (model.weights == 0).mean() > 0.5
    out = language_id.predict(df, model, kept=("doc_id", "lang_pred")).toDF("doc_id", "own", "lang_pred", "score").collect()
    assert len(out) == len(rows) and {r.own for r in out} == {"s"}
    by_key = {r.doc_id: r for r in out if r.doc_id in (None, 7, 8, 9, 10)}
    assert [by_key[k].lang_pred for k in (None, 10)] == ["aa", "xx"]
    blank = [r for r in out if r.lang_pred == "und"]
    assert len(blank) == 3 and {r.score for r in blank} == {0.0}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language_id.train(df) is None
    assert [(r.lang_pred, r.score) for r in language_id.predict(df, None).collect()] == [("und", 0.0)] * 2
    assert language_id.predict(df.limit(0), None).collect() == []
    one = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predict(one, language_id.train(one)).collect()] == ["en"]


def test_temperature_is_the_best_of_its_grid(spark):
    rng = np.random.default_rng(3)
    words = ["abc", "bcd", "xyz", "yzx"]
    rows = [(i, " ".join(rng.choice(words, 4)), int(rng.integers(2))) for i in range(80)]
    model = language_id.Model(["a", "b"], rng.normal(size=(1 << language_id.BITS, 2)).astype(np.float32) * 9, np.zeros(2))
    df = spark.createDataFrame([(t, y) for _, t, y in rows], "body string, label int").repartition(4)
    model.temperature = language_id._temperature(df, model)

    def loss(temperature):
        p = language_id.softmax(model.logits(pa.array([t for _, t, _ in rows])) / temperature)
        return -np.log(p[np.arange(len(rows)), [y for *_, y in rows]]).sum()

    assert loss(model.temperature) <= min(map(loss, language_id.TEMPERATURES)) + 1e-9
    assert df.select(F.max("label")).first()[0] == 1
