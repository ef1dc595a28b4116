from __future__ import annotations

from pyspark.sql import functions as F

from govspark.llm import quality
from govspark.sources.tables import table


def test_held_out_accuracy_and_whole_results(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = quality.score(docs, labels.filter(~hidden)).cache()
    assert found.count() == docs.count() and found.filter("score IS NULL").count() == 0
    judged = found.join(labels.filter(hidden), "doc_id")
    right = judged.filter("keep = (quality = 1)").count()
    assert right >= 0.95 * judged.count()
    assert judged.filter("quality = 1 AND keep").count() >= 0.97 * judged.filter("quality = 1").count()
    kept = quality.keep_good(docs, labels.filter(~hidden))
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_odd_rows(spark):
    good, bad = "Some plain words stand here, one after another. ", "BUY!! BUY!! BUY!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5) + str(i), None if i % 3 else "en", "s", i) for i in range(80)]
    rows += [(1000, None, None, None, None), (1001, "", "x", "", 0), (None, good, "en", "s", 1), (3, rows[3][1], None, "s", 3)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(1, 0, 1), (1, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    found = quality.score(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(r.keep == bool(r.doc_id % 2) for r in found if r.doc_id is not None and r.doc_id < 80)


def test_repeated_labelled_keys_weigh_once_each(spark, monkeypatch):
    fitted = []
    fit = quality._fit
    monkeypatch.setattr(quality, "_fit", lambda rows, view: (fitted.append((view, rows.count())), fit(rows, view))[1])
    rows = [(i, f"word {i} and more of it", "en", "s", i) for i in range(300)] + [(7, "again and again", "de", "t", 3)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert len(quality.score(docs, labels, rounds=0).collect()) == 800
    assert sum(n for view, n in fitted if view in ("view", "both")) == 800


def test_without_labels_all_is_kept(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in quality.score(docs, none).collect()] == [(1, None, None, None, True)]
    assert quality.score(docs.limit(0), none).collect() == []
    assert quality.keep_good(docs, none).count() == 1
