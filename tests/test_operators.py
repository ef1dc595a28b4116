"""Operators against brute force on small and skewed inputs."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from govspark.functions import documents
from govspark.operators import buckets, chunk, flatten, history, joins, ordered, profile, quota, retrieval, vector
from govspark.operators.topk import lookup_for_few, topk_with_total
from govspark.plans import ingest
from govspark.sources import scans, sinks


@pytest.mark.parametrize("window_rows", [0, 10**6])
def test_running_over_hot_and_null_groups(spark, window_rows):
    rng = random.Random(1)
    day = dt.datetime(2024, 1, 1)
    rows = [
        (rng.choice(["hot", "hot", "hot", "0", None]), rng.choice([day, None]), i, rng.randint(0, 9))
        for i in rng.sample(range(10_000), 2_000)
    ]
    df = spark.createDataFrame(rows, "g string, d timestamp_ntz, o int, v int")
    got = ordered.running(df, ["g", "d"], ["o"], {"s": F.col("v")}, totals=True, window_rows=window_rows, parts=16).collect()
    sums: dict = {}
    expected = set()
    for g, d, o, v in sorted(rows, key=lambda r: r[2]):
        sums[g, d] = sums.get((g, d), 0) + v
        expected.add((g, d, o, v, sums[g, d]))
    assert {(r["g"], r["d"], r["o"], r["v"], r["s"]) for r in got} == expected and len(got) == len(rows)
    assert {((r["g"], r["d"]), r["s_total"]) for r in got} == set(sums.items())


@pytest.mark.parametrize("window_rows", [0, 10**6])
def test_positions_at_the_edges(spark, window_rows):
    same = spark.createDataFrame([("g", 5, i) for i in range(20)], "g string, o int, t int")
    got = ordered.positions(same, ["g"], ["o", "t"], "n", window_rows=window_rows)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 21))
    assert ordered.positions(same.where("o < 0"), ["g"], ["o", "t"], window_rows=window_rows).count() == 0


def test_top_k_with_its_total(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    order = [F.col("v").desc(), F.col("id").asc()]
    a = topk_with_total(df, order, 7).collect()
    best = sorted(((r["v"], -r["id"]) for r in df.collect()), reverse=True)[:7]
    assert [(r["v"], -r["id"]) for r in a] == best and a[0]["total_count"] == 5000
    nothing = df.where("v < 0")
    assert topk_with_total(nothing, order).collect() == []


def test_report_lookup_forms_agree(spark, monkeypatch):
    few = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (9, "d")], "k int, v string")
    many = spark.range(5).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))
    expected = {(1, "a", 10), (2, "b", 20), (None, "c", None), (9, "d", None)}
    for k in (10, 10_000, 10_000_000):
        assert {tuple(r) for r in lookup_for_few(few, many, "k", k).select("k", "v", "w").collect()} == expected


@pytest.mark.parametrize("group_rows", [10, 10**6])
def test_salted_join(spark, group_rows):
    rows = [("hot", i) for i in range(300)] + [("a", 1), ("b", 2), (None, 3), ("lost", 4)]
    many = spark.createDataFrame(rows, "k string, v int")
    one = spark.createDataFrame([("hot", "H"), ("a", "A"), ("b", "B"), (None, "N")], "k string, w string")
    names = {"hot": "H", "a": "A", "b": "B"}
    got = joins.salted_join(many, one, "k", group_rows).collect()
    assert sorted((r["k"], r["v"], r["w"]) for r in got) == sorted((k, v, names[k]) for k, v in rows if k in names)


def test_new_records_forms_agree(spark, monkeypatch):
    source = spark.createDataFrame([(1,), (2,), (None,), (5,)], "k int")
    target = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    small = sorted(r[0] for r in joins.new_records_of_small_batch(source, target, "k").collect())
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 1)
    large = sorted(r[0] for r in joins.new_records_of_small_batch(source, target, "k").collect())
    assert small == large == [1, 5]


NESTED = [
    (1, {"a b": {"x": 1, "Y-z": [10, {"q": "s"}, []]}, "e": {}, "l": [], "n": None, "t": True}),
    (2, {"a b": 5}),
    (3, [1, [2, {"k": 3}]]),
]


def flat(value, prefix=""):
    steps = value.items() if isinstance(value, dict) else enumerate(value)
    for key, inner in steps:
        name = "_".join(filter(None, [prefix, flatten.sanitize_name(str(key))]))
        if isinstance(inner, (dict, list)):
            yield from flat(inner, name)
        else:
            yield name, inner


def as_text(value):
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def test_flatten_long(spark):
    rows = [(i, json.dumps(v)) for i, v in NESTED] + [(4, "{damaged"), (5, None)]
    df = spark.createDataFrame(rows, "id int, record string")
    got = {(r["id"], r["path"], r["value"]) for r in flatten.flatten_long(df, "id", "record").collect()}
    assert got == {(i, path, as_text(v)) for i, value in NESTED for path, v in flat(value)}


def test_flatten_long_at_any_depth(spark):
    record = json.dumps({"k[{": "]}\\\"["})
    for _ in range(12):
        record = f'{{"a":[{record}]}}'
    df = spark.createDataFrame([(1, record), (2, "7"), (3, "{}")], "id int, record string")
    got = [tuple(r) for r in flatten.flatten_long(df, "id", "record").select("id", "path", "value").collect()]
    assert sorted(got) == [(1, "a_0_" * 12 + "k", ']}\\"['), (2, "", "7")]
    with pytest.raises(ValueError, match="25 deep"):
        flatten.flatten_long(df, "id", "record", 24)


def test_flatten_wide(spark):
    records = [{"a": [{"b": [1, 2, 3]}, {"c": "x"}], "m": {"d e": 1.5}}, {"a": [], "m": None}, {"a": [{"b": [7]}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, record string")
    parsed = flatten.parse_records(df, "record").select("id", "record.*")
    row = flatten.flatten_wide(parsed).where("id = 0").first().asDict()
    expected = {"id": 0, **{k: v for k, v in flat(records[0])}}
    assert {k: float(v) if k == "m_d_e" else v for k, v in row.items() if v is not None} == expected
    with pytest.raises(ValueError, match="longer than 2"):
        flatten.flatten_wide(parsed, max_array=2)
    long = spark.createDataFrame([([{"v": i} for i in range(40)],)], "t array<struct<v:int>>")
    assert list(flatten.flatten_wide(long).first()) == list(range(40))


def test_flatten_wide_collision(spark):
    parsed = spark.createDataFrame([(1, 2)], "createdAt int, createdat_ int")
    with pytest.raises(ValueError, match="collide"):
        flatten.flatten_wide(parsed)
    assert flatten.flatten_wide(parsed, on_collision="last").first()["createdat"] == 2


def brute_topk(vectors, queries, k):
    out = set()
    for q, x in queries:
        scored = sorted((-round(1 - float(((np.array(v) - x) ** 2).sum()), 6), i) for i, v in vectors)
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(scored[:k])}
    return out


def test_vector_search_forms(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(150)]  # a third are copies of one vector
    queries = [(q, np.array(rng.normal(size=4))) for q in range(6)]
    v = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in queries], "query_id bigint, embedding array<double>")
    expected = brute_topk(vectors, queries, 7)
    few = vector.topk(v, q, 7)
    blocks = vector.topk(v, q, 7, max_query_bytes=0, block_rows=100)
    for hits in (few, blocks):
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in hits.collect()} == expected
    assert vector.topk(v, q.where("query_id < 0"), 7).count() == 0


def test_bucketed_search_recall(spark, tmp_path):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 16))
    points = np.concatenate([c + 0.2 * rng.normal(size=(40, 16)) for c in centers]).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers[:3])], "query_id bigint, embedding array<double>")
    path = str(tmp_path / "b")
    buckets.write_bucketed(v, path)
    exact = {(r["query_id"], r["vec_id"]) for r in vector.topk(v, q, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in buckets.approx_topk(spark, path, q, 10, probes=8).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    every = {(r["query_id"], r["vec_id"]) for r in buckets.approx_topk(spark, path, q, 10, probes=64).collect()}
    assert every == exact
    one = buckets.approx_topk(spark, path, q.where("query_id = 0"), 700, probes=1)
    assert one.count() == 700
    # blocks of a few vectors, and as many queries as vectors
    many = v.select(F.col("vec_id").alias("query_id"), "embedding")
    cut = buckets.approx_topk(spark, path, many, 3, probes=16, block_bytes=16 * 8 * 10)
    truth = vector.topk(v, many, 3)
    assert {tuple(r) for r in cut.select("query_id", "vec_id", "rank").collect()} == {tuple(r) for r in truth.select("query_id", "vec_id", "rank").collect()}
    assert buckets.recall(cut, truth).agg(F.min("recall")).first()[0] == 1.0


def test_probed_buckets_are_the_cheapest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 6))
    side = x @ buckets.planes(6, 7)
    own = (side > 0).astype(int)
    flips = np.arange(128)[:, None] >> np.arange(7) & 1
    for i, row in enumerate(buckets.probed_buckets(x, 9, 7)):
        cost = flips @ np.abs(side[i])
        best = ((own[i] ^ flips) @ (1 << np.arange(7)))[np.argsort(cost)[:9]]
        assert row.tolist() == best.tolist()
    assert [buckets.bits_for(n) for n in (0, 32_000, 10**6, 10**12)] == [4, 4, 9, 16]


def test_ingest_from_files(spark, tmp_path):
    envelopes = {
        "polkadot_ReferendumV2_Root_20240101.json": [
            {"index": 1, "createdAt": "2024-01-01T00:00:00", "onChainInfo": {"hash": "0xa", "beneficiaries": [{"amount": "10", "assetId": None}]}},
            {"index": 2, "title": "t", "tags": [{"value": "v"}], "other": {}},
        ],
        "kusama_Bounty_20240101.json": [{"index": 3, "index ": 4, "onChainInfo": {"hash": "0xb"}}],
        "polkadot_Tip_20240101.json": [],
    }
    for name, items in envelopes.items():
        (tmp_path / name).write_text(json.dumps({"network": "n", "items": items}, indent=2))
    items = ingest.raw_items(spark, str(tmp_path))
    wide = ingest.wide_table(items)
    rows, missing, extra = ingest.curated(wide, {"index": "integer", "createdat": "timestamp"})
    got = {r["row_index"]: r for r in rows.collect()}
    assert set(got) == {"polkadot_ReferendumV2_1_0xa", "polkadot_ReferendumV2_2_", "kusama_Bounty_4_0xb"}
    first = got["polkadot_ReferendumV2_1_0xa"]
    assert (first["source_row_id"], first["onchaininfo_beneficiaries_0_amount"], first["createdat"].year) == (1, "10", 2024)
    assert "topic" in missing and extra == [] and rows.columns[:4] == ["source_file", "source_network", "source_proposal_type", "source_row_id"]
    known = rows.where("index = 2").select("row_index")
    assert {r["row_index"] for r in ingest.new_rows(rows, known).collect()} == set(got) - {"polkadot_ReferendumV2_2_"}


def test_hash_embeddings(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "!!"), (3, "one two two")], "id int, content string")
    rows = {r["id"]: np.array(r["embedding"]) for r in vector.hash_embeddings(df, 32).collect()}
    assert np.isclose(np.linalg.norm(rows[1]), 1) and not rows[2].any() and (rows[1] == rows[3]).all()


def test_pluggable_encoder(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "id int, content string")
    got = vector.embed(df, lambda texts: np.array([[len(x), 1.0] for x in texts]), batch=3)
    assert {r["id"]: r["embedding"] for r in got.collect()} == {i: [float(i), 1.0] for i in range(1, 8)}


def test_chunks_hold_all_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(3000)]
    text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for w in words) + "".join(rng.choices("ghijklmn", k=900))
    size, overlap = 50, 10
    chunks = [c.strip() for c in chunk.split_text(text, size, overlap)]
    assert all(chunk.quarter_length(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # each chunk starts inside or right after the text covered so far
        found = text.index(c, max(0, at - 4 * (overlap + size)))
        assert text[at:found].strip() == ""
        at = max(at, found + len(c))
    assert text[at:].strip() == ""
    df = spark.createDataFrame([(1, text, "s"), (2, "  ", "s"), (3, None, "s")], "doc_id bigint, text string, source string")
    rows = chunk.chunk_recursive(df, size, overlap).orderBy("chunk_index").collect()
    assert [r["content"] for r in rows] == [c for c in chunks if c] and {r["doc_id"] for r in rows} == {1}


def test_chunks_overlap():
    chunks = list(chunk.split_text(" ".join(f"w{i:03d}" for i in range(200)), 20, 8))
    assert all(set(a.split()) & set(b.split()) for a, b in zip(chunks, chunks[1:]))


def test_combined_parts_are_the_document(spark):
    files = [("g", i, f"t{i}", "x" * (i * 7 % 50)) for i in range(60)]
    df = spark.createDataFrame(files, "g string, i int, title string, body string")
    parts = documents.combine_by_group(df, "g", "i", "title", "body", 200).orderBy("part").collect()
    whole = "\n".join(f"\n\n--- FILE: {t} ---\n{b}" for _, _, t, b in files if b)
    assert "\n".join(r["content"] for r in parts) == whole and len(parts) > 5


def greedy(lines, markers, budget):
    near = {j for i, l in enumerate(lines) if any(m in l for m in markers) for j in range(i, min(i + 10, len(lines)))}
    order = [l for i, l in enumerate(lines) if i in near] + [l for i, l in enumerate(lines) if i not in near and len(l) < 200]
    used, kept = 0, []
    for line in order:
        if line not in kept and used + len(line) + 1 < budget:
            kept.append(line)
            used += len(line) + 1
    return "\n".join(kept)


def test_trim(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["KEY:", "a" * rng.randint(0, 250), "same"]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in df.select("x", history.trim_to_budget(F.col("x"), ["KEY:"], 700).alias("y")).collect():
        assert row["y"] == greedy(row["x"].split("\n"), ["KEY:"], 700)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, vec_id int, score double, rank int, title string, url string, flag boolean")


def test_rerank_branches(spark):
    df = hits(spark, [
        (1, 1, 0.9, 1, "a", "", False), (1, 2, 0.85, 2, "b", "", True), (1, 3, 0.84, 3, "c", "", True),
        (2, 4, 0.9, 1, "a", "", False), (2, 5, 0.8, 2, "b", "", True),
        (3, 6, 0.5, 1, "a", "", False),
    ])
    kept = retrieval.rerank_flagged(df, F.col("flag")).collect()
    assert {(r["query_id"], r["vec_id"]) for r in kept} == {(1, 2), (2, 4), (2, 5), (3, 6)}


def brute_sources(urls):
    listed = []
    for u in urls[:3]:
        if (u and u not in listed) or (not u and len(listed) < 2):
            listed.append(u)
        if len(listed) >= 2 and any(listed):
            break
    return listed


def test_sources(spark):
    import itertools

    cases = list(itertools.product(["", "u", "v"], repeat=3)) + [("",), ("u", "u"), ("", "", "u", "v")]
    rows = [(q, i, 0.9 - i / 10, i + 1, "t", u, False) for q, urls in enumerate(cases) for i, u in enumerate(urls)]
    got = retrieval.extract_sources(hits(spark, rows)).orderBy("query_id", "position").collect()
    for q, urls in enumerate(cases):
        assert [r["url"] for r in got if r["query_id"] == q] == brute_sources(list(urls))


def test_context_stops_at_first_overflow(spark):
    rows = [(1, i, 0.5, i, "t", "", "s", c) for i, c in enumerate(["a" * 10, "b" * 500, "c"], 1)]
    df = spark.createDataFrame(rows, "query_id int, vec_id int, score double, rank int, title string, url string, source string, content string")
    packed = retrieval.pack_context(df, 200).first()
    assert packed["chunks_used"] == 1
    assert packed["context"] == "--- Document 1 ---\nTitle: t\nSource: s\n\nContent:\n" + "a" * 10 + "\n\n"
    exact = retrieval.pack_context(df, len(packed["context"])).first()
    assert exact["chunks_used"] == 1


def test_gate(spark):
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id int")
    found = spark.createDataFrame([(2, 0.4), (3, 0.9), (4, 0.9)], "query_id int, score double")
    texts = spark.createDataFrame([(2, "x"), (4, "x")], "query_id int, context string")
    rows = {r["query_id"]: (r["sufficient"], r["reason"]) for r in retrieval.context_gate(queries, found, texts).collect()}
    assert rows == {
        1: (False, "No relevant chunks found"), 2: (False, "Low similarity scores (max: 0.400 < 0.6)"),
        3: (False, "Retrieved chunks contain no usable content (similarity: 0.900)"), 4: (True, None),
    }


def test_quota_of_a_busy_user(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 else 2, start + dt.timedelta(seconds=11 * i)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp_ntz")
    seen: dict = {}
    expected = set()
    for i, user, ts in rows:
        window = (user, ts.replace(minute=0, second=0))
        seen[window] = seen.get(window, 0) + 1
        expected.add((i, seen[window] <= 20, max(0, 20 - seen[window])))
    assert {(r["event_id"], r["allowed"], r["remaining"]) for r in quota.quota_batch(df).collect()} == expected


def test_files_of_every_kind(spark, tmp_path):
    item = "struct<id:bigint,title:string>"
    files = {
        "good": {"network": "n", "timestamp": "t", "total_items": 2, "items": [{"id": 1, "title": "a"}, {"id": 2}]},
        "empty": {"network": "n", "items": []},
        "missing": {"network": "n"},
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "bad.json").write_text('{"network": "n", "items": [')
    rows = scans.scan_envelopes(spark, str(tmp_path), item, multi_line=True).collect()
    assert {(r["network"], r["id"], r["title"]) for r in rows} == {("n", 1, "a"), ("n", 2, None)}
    report = {r["file"].rsplit("/", 1)[1]: (r["success"], r["items"]) for r in scans.file_report(spark, str(tmp_path), item, True).collect()}
    assert report == {"good.json": (True, 2), "empty.json": (False, 0), "missing.json": (False, 0), "bad.json": (False, 0)}


def test_votes_in_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"v": 1}, {"v": 2}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"v": 3}]))
    (tmp_path / "c.json").write_text("[broken")
    got = scans.scan_votes(spark, str(tmp_path)).select(flatten.path_value(F.col("element"), "v", "int").alias("v"))
    assert sorted(r["v"] for r in got.collect()) == [1, 2, 3]
    both = scans.scan_list_or_object(spark, str(tmp_path)).count()
    assert both == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.txt").write_text("Title: A\n\nbody")
    (tmp_path / "sub" / "one.json").write_text("{}")
    (tmp_path / "sub" / "two.json").write_text("{}")
    files = scans.scan_texts(spark, str(tmp_path))
    kept = documents.text_before_json(files.select("folder", "stem", "extension"))
    assert {tuple(r) for r in kept.collect()} == {("sub", "one", "txt"), ("sub", "two", "json")}


def test_collection_is_replaced_alone(spark, tmp_path):
    def chunks(collection, n):
        return spark.range(n).select(F.lit(collection).alias("collection"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"))

    path = str(tmp_path / "v")
    sinks.write_vectors(chunks("static", 3).unionByName(chunks("dynamic", 4)), path)
    sinks.write_vectors(chunks("static", 2), path)
    counts = {r["collection"]: r["count"] for r in spark.read.parquet(path).groupBy("collection").count().collect()}
    assert counts == {"static": 2, "dynamic": 4}


def test_append_is_verified(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.load_table(spark.range(5), path).first()["complete"]
    assert tuple(sinks.load_table(spark.range(3), path, "append").select("rows_after", "complete").first()) == (8, True)


def test_profile_forms_agree(spark):
    df = spark.range(500).select(
        F.col("id"), F.when(F.col("id") < 100, F.col("id").cast("string")).alias("some"), F.lit(1.5).alias("one"), F.lit(None).cast("string").alias("none")
    )
    exact = {r["column_name"]: r for r in profile.profile_columns(df).collect()}
    approx = {r["column_name"]: r for r in profile.profile_columns_approx(df).collect()}
    for name, distinct in {"id": 500, "some": 100, "one": 1, "none": 0}.items():
        assert exact[name]["unique_count"] == distinct and abs(approx[name]["unique_count"] - distinct) <= 0.05 * distinct
        assert exact[name]["null_count"] == approx[name]["null_count"]
    assert exact["none"]["sample_values"] is None and exact["some"]["sample_values"] == "0 | 1 | 10 | 11 | 12"
    flags = {r["column_name"]: (r["has_nulls"], r["is_unique"]) for r in profile.structure_profile(df).collect()}
    assert flags == {"id": (False, True), "some": (True, False), "one": (False, False), "none": (True, False)}


def test_file_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    rows = profile.file_inventory(spark.read.parquet(path)).collect()
    assert sorted((r["row_count"], r["column_count"]) for r in rows) == [(5, 1), (10, 1)]
    assert all(r["bytes"] > 0 for r in rows)


def test_estimates_are_held_against_exact_numbers(spark, sf_dir):
    from govspark.suite import ORACLES, QUERIES

    rows = QUERIES["profile_columns_approx"](spark, sf_dir).collect()
    assert "near_exact" in ORACLES["profile_columns_approx"] and len(rows) == 6 and all(r["near_exact"] for r in rows)
    assert all(r["unique_count"] > 0 for r in QUERIES["profile_columns_estimates"](spark, sf_dir).collect())


def test_chunks_leave_in_small_batches():
    import pyarrow as pa

    texts = [None if i % 7 == 0 else "one two three. " * 40 * (i % 5) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts), pa.array(["s"] * 50)], names=["doc_id", "text", "source"])
    split = lambda text: chunk.split_text(text, 20, 5)
    whole, parts = (list(chunk.chunk_batches(iter([batch]), split, chunk.quarter_length, n)) for n in (10**9, 1000))
    assert len(parts) > 10 and max(p.num_rows for p in parts) < whole[0].num_rows / 5
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()


@pytest.mark.parametrize("group", [["g"], []])
def test_a_group_of_long_texts_is_cut(spark, group):
    rows = [(i % 2, i // 2, "x" * 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, k long, body string").withColumn("all", F.lit(0))
    by = group or ["all"]
    cut = ordered.running(df, by, ["k"], {"upto": F.length("body")}, totals=True, window_bytes=20_000)
    assert "_part" in cut._jdf.queryExecution().analyzed().toString()  # few rows were one window before
    whole = ordered.running(df, by, ["k"], {"upto": F.length("body")}, totals=True)
    plain = lambda x: sorted((r["g"], r["k"], r["upto"], r["upto_total"]) for r in x.collect())
    if group:
        assert plain(cut) == plain(whole)
    assert sorted(r["upto"] for r in cut.collect()) == sorted(r["upto"] for r in whole.collect())


@pytest.mark.parametrize("by", ["_key", "_hot", "_part", "_g0", "__cut"])
def test_cut_groups_may_be_named_like_helpers(spark, by):
    df = spark.createDataFrame([(f"g{i % 3}", i, "x" * 100) for i in range(90)], f"{by} string, o int, body string")
    got = ordered.running(df, [by], ["o"], {"_m_n": F.lit(1)}, totals=True, window_bytes=1000)
    assert got.columns == [by, "o", "body", "_m_n", "_m_n_total"]
    assert sorted((r["o"], r[by], r["_m_n"], r["_m_n_total"]) for r in got.collect()) == [(i, f"g{i % 3}", i // 3 + 1, 30) for i in range(90)]
