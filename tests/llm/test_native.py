"""URL templates, sharding and licence digests."""

from __future__ import annotations

import zlib
from collections import defaultdict
from importlib import resources

import pytest
from pyspark.sql import functions as F

from govspark.llm import license_scan, sharding, url_templates
from govspark.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference


def reference_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("name", ["op4_url_templates", "op6_license_digests", "op10_benchmark_decontamination"])
def test_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


@pytest.mark.parametrize("shards", [1, 2, 16, 100])
def test_jump(spark, shards):
    rows = spark.range(400).select(F.xxhash64("id").alias("k")).select("k", sharding.jump(F.col("k"), shards).alias("s")).select("k", "s.last", "s.b")
    for r in rows.collect():
        assert (r["last"], r.b) == (reference_jump(r.k, shards), reference_jump(r.k, shards + 1))


def test_shards(spark, sf_dir):
    rows = [(i, "é" * (i % 7), 1) for i in range(300)] + [(300, None, 1), (None, "x", 1), (5, "é" * 5, 1)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), shards=4).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    texts = dict((k, t) for k, t, _ in rows)
    for r in found:
        body = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert len(slots) == 4 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_leave_columns_of_any_name(spark):
    rows = [(1, "a", 7, "x", 5.0, True), (2, "b", 8, "y", 6.0, False), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _part int, _to string, _at double, _start boolean")
    found = sharding.shard(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r["_part"], r["_to"], r["_at"], r["_start"]) for r in found] == [(r[0], *r[2:]) for r in rows]


def test_write_shards(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(r.doc_id, r.shard) for r in sharding.shard(docs, shards=3).collect()}


def test_urls(spark):
    urls = [
        None, "", "no scheme", "HTTP://A.Example.ORG", "http://example.org/es/1", "http://notexample.org/es/1", "http://x.com/fr/a?b=http://y.com/de/", "http://com/de/x#y",
        "http://x.com/other", "http://x.com/other",
    ] + [f"http://big.com/{'de' if i % 3 else 'fr'}/page{i}" for i in range(40)] + ["http://big.com/new/1", "http://big.com/deaf0123456789/1//"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, shape string, n int")
    found = {r.page_id: r for r in url_templates.judge(pages).collect()}
    assert len(found) == len(urls)
    assert [tuple(found[i])[1:5] for i in range(8)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "", None, "allow"), ("example.org", "/es/1", "example.org/es/", "block"),
        ("notexample.org", "/es/1", "org/", "allow"), ("x.com", "/fr/a", "com/fr/", "allow"), ("com", "/de/x", "com/de/", "block"),
    ]
    labelled = pages.withColumn("said", F.when(F.col("url").contains("/de/"), "block").when(F.col("url").contains("/fr/"), "allow"))
    learned = url_templates.judge(labelled, label="said", rules=()).filter("host = 'big.com'").groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict) for r in learned} >= {("/de/page#", "block"), ("/fr/page#", "allow")}
    assert url_templates.judge(pages.limit(0)).collect() == []


def test_licences(spark):
    mit = f"The MIT licence (MIT)\n\n  Copyright (c) 2020 Someone\n\n{license_scan._MIT_GRANT}\n\n{license_scan._MIT_WARRANTY}".replace("the rights", "the   Rights,")
    rows = [(1, mit), (2, None), (3, "copyright x"), (4, "a\n# SPDX-License-Identifier: MIT\nReleased under the MIT license"), (1, mit), (5, mit + " more"), (6, "é")]
    found = license_scan.scan(spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, digest string"), license_scan.known_licenses(spark)).collect()
    assert sorted((r.doc_id, r.digest is None, tuple(r.text_licenses), tuple(r.line_licenses)) for r in found) == [
        (1, False, ("MIT",), ()), (1, False, ("MIT",), ()), (2, True, (), ()), (3, True, (), ()), (4, False, (), ("MIT",)), (5, False, (), ()), (6, False, (), ()),
    ]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string"), license_scan.known_licenses(spark)).collect() == []


def test_whole_licences_titles_and_list_marks(spark):
    whole = {f.name.removesuffix(".txt"): f.read_text() for f in resources.files(license_scan.__package__).joinpath("licenses").iterdir()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(whole)
    end = "END OF TERMS AND CONDITIONS"
    head = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n"
    two, three, warranty = license_scan._BSD_2, license_scan._BSD_3, license_scan._BSD_WARRANTY
    bullets = f"{two}\n{three}".replace("1. ", " * ").replace("2. ", " * ").replace("3. ", " * ")
    rows = [(f"{name}", text) for name, text in whole.items()]
    rows += [(name, whole[name].split(end)[0] + tail) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1") for tail in ("", end)]
    rows += [("GPL-3.0", "\n\n".join(" ".join(line.split()) for line in whole["GPL-3.0"].split("\n"))), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{head}{two}\n\n{three}\n\n{warranty}")]
    rows += [("BSD-3-Clause", f"{head}{bullets}\n{warranty}"), ("BSD-3-Clause", f"The BSD 3-Clause License\n{head}{bullets}\n{warranty}"), ("BSD-2-Clause", f"BSD 2-Clause License\n{head}{two}\n{warranty}")]
    rows += [("MIT", f"The MIT License\n{head}{license_scan._MIT_GRANT}\n{license_scan._MIT_WARRANTY}"), ("", f"BSD 3-Clause License\n{two} more"), ("", whole["GPL-3.0"].replace("free", "dear"))]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = dict(license_scan.scan(docs, license_scan.known_licenses(spark)).select("doc_id", F.array_join("text_licenses", ",")).collect())
    assert [found[i] for i in range(len(rows))] == [name for name, _ in rows]
