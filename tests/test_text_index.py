from __future__ import annotations

import random
import re

import pytest

from govspark.operators import text_index


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def cut(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def brute(posts, query, k, among=None):
    asked = cut(query)
    found = []
    for key, *texts in posts:
        if among is not None and key not in among:
            continue
        typos, best = 0, []
        for w in asked:
            allowed = 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0
            places = [(distance(w, t), a, p) for a, text in enumerate(texts) for p, t in enumerate(cut(text)) if abs(len(t) - len(w)) <= allowed]
            places = [x for x in places if x[0] <= allowed]
            if not places:
                break
            least = min(places)[0]
            typos += least
            best.append([(a, p) for d, a, p in places if d == least])
        if not asked or len(best) < len(asked):
            continue
        near = [min((max(1, abs(p - q)) for a, p in x for b, q in y if a == b), default=8) for x, y in zip(best, best[1:])]
        found.append((typos, sum(min(8, d) for d in near), sum(min(a for a, _ in x) for x in best), key))
    return [(key, t, p, a, i + 1) for i, (t, p, a, key) in enumerate(sorted(found)[:k])]


@pytest.fixture(scope="module")
def posts():
    rng = random.Random(4)
    words = ["treasury", "treasure", "council", "counsel", "vote", "votes", "voté", "referendum", "referendums", "tip", "tips", "a", "spending", "proposal", "漢字漢字", "aaaa", "aaab"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))

    rows = [(i, rng.choice([None, "", text(2)]), text(rng.choice([0, 3, 12, 40]))) for i in range(150)]
    return [*rows, (1000, "common " * 3, "common " * 5000 + "treasury"), *[(2000 + i, "common", "common vote") for i in range(200)]]


@pytest.fixture(scope="module")
def index(spark, posts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    kept, text_index.FOLDER_ROWS = text_index.FOLDER_ROWS, 200
    text_index.build(spark.createDataFrame(posts, "id long, title string, body string").repartition(3), path, "id", ["title", "body"])
    text_index.FOLDER_ROWS = kept
    return path


QUERIES = ["tresury", "council vote", "referndm spendig", "vot", "tip", "tipp", "common vote", "comon tresury", "", "?!", "nothing here", "漢字漢", "aaaa aaab aaaa", "voté proposals counsil", "a a", "treasurytreasury"]


@pytest.mark.parametrize("terms", [1000, 3])
def test_against_brute_force(spark, posts, index, monkeypatch, terms):
    monkeypatch.setattr(text_index, "FILTER_TERMS", terms)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    found = text_index.search(spark, index, queries, k=7).collect()
    got = {i: sorted(((r.key, r.typos, r.proximity, r.attribute, r.rank) for r in found if r.query_id == i), key=lambda x: x[-1]) for i in range(len(QUERIES))}
    assert got == {i: brute(posts, q, 7) for i, q in enumerate(QUERIES)}
    some = spark.createDataFrame([(i,) for i in range(0, 3000, 3)], "key long")
    found = text_index.search(spark, index, queries, k=7, among=some).collect()
    for i, q in enumerate(QUERIES):
        rows = sorted((r.rank, r.key) for r in found if r.query_id == i)
        assert [key for _, key in rows] == [x[0] for x in brute(posts, q, 7, set(range(0, 3000, 3)))]


def test_a_search_reads_the_postings_of_its_terms(spark, index):
    wanted = spark.createDataFrame([("treasury",), ("vote",)], "term string")
    read = text_index._read(spark, index, "postings", "term", wanted)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "In(term, [treasury,vote])" in plan
    folders = {r.folder for r in spark.read.parquet(f"{index}/postings").select("folder").distinct().collect()}
    assert len(folders) >= 4
    assert {r.term for r in read.select("term").distinct().collect()} == {"treasury", "vote"}


def test_a_hot_term_lies_in_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would be put together
    df = spark.createDataFrame([(i, "common vote") for i in range(20_000)], "id long, body string")
    text_index.build(df, str(tmp_path / "x"), "id", ["body"])
    files = spark.read.parquet(str(tmp_path / "x" / "postings")).selectExpr("input_file_name() AS f", "term").distinct().groupBy("term").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["count"] > 1 for r in files)


def test_hits_do_not_grow_with_equal_queries(spark, index, monkeypatch):
    """Places move once, whatever the number of queries, and as many queries as do not fit one pass take several."""
    moved = []
    kept = text_index._search_pass
    monkeypatch.setattr(text_index, "_search_pass", lambda places, *more: (moved.append(places.count()), kept(places, *more))[1])
    few = spark.createDataFrame([(0, "common vote")], "query_id long, query string")
    many = spark.createDataFrame([(i, "common vote") for i in range(60)], "query_id long, query string")
    first = {r.key: r.rank for r in text_index.search(spark, index, few).collect()}
    found = text_index.search(spark, index, many).collect()
    assert moved[0] == moved[1] and len(moved) == 2
    assert len(found) == 60 * len(first) and all(first[r.key] == r.rank for r in found)
    monkeypatch.setattr(text_index, "NEAR_ROWS", 40)
    again = text_index.search(spark, index, many).collect()
    assert len(moved) > 3 and sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_places_are_read_once_for_all_passes(spark, index, monkeypatch):
    met, passes = [], []
    of, searched = text_index._met, text_index._search_pass
    monkeypatch.setattr(text_index, "_met", lambda *a: (met.append(a[2]), of(*a))[1])
    monkeypatch.setattr(text_index, "_search_pass", lambda *a: (passes.append(a[0]), searched(*a))[1])
    monkeypatch.setattr(text_index, "NEAR_ROWS", 4)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["tresury", "council vote", "common vote"])], "query_id long, query string")
    assert text_index.search(spark, index, asked).count() == 15
    assert met.count("term") == 1 and len(passes) > 1


def test_keys_far_apart_and_none(spark, tmp_path):
    keys = [-(2**62), -5, 0, 3, 2**62, 2**62 + 1, None]
    df = spark.createDataFrame([(k, "vote vote tally") for k in keys], "id long, body string").coalesce(1)
    text_index.build(df, str(tmp_path / "x"), "id", ["body"])
    asked = spark.createDataFrame([(1, "tally vote"), (2, "tally vote")], "query_id long, query string")
    found = text_index.search(spark, str(tmp_path / "x"), asked, k=10).collect()
    for query in (1, 2):
        assert [r.key for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == query] == [None, *keys[:-1]]
