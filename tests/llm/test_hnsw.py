from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from govspark.llm.hnsw import build_graph, nearest, search_graph


def test_recall_of_a_graph():
    x = np.random.default_rng(1).normal(size=(3000, 24)) * np.random.default_rng(2).uniform(0.5, 2, (3000, 1))
    order, long, levels = build_graph(x)
    q = x[::10]
    found = search_graph(long, levels, q, 20)
    truth = np.argsort(-(q @ x[order].T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, truth)]) >= 0.9


def test_exact_on_small_tables_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(120)] + [(200 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(60)]
    odd = [(400, None), (420, [0.0] * 4), (440, [float("nan"), 1.0, 1.0, 1.0]), (460, [None, 1.0, 1.0, 1.0]), (480, [float("inf"), 0.0, 0.0, 0.0]), (500, []), (520, [1.0, 1.0]), (20, rows[20][1])]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got: dict[int, list] = {}
    for r in sorted(nearest(df, lambda i: i % 20 == 0, k=20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = {i: np.array(v) for i, v in rows if any(v)}
    truth = {}
    for q in (i for i in usable if i % 20 == 0):
        best = sorted((-float(usable[q] @ v), i) for i, v in usable.items() if i != q)[:20]
        truth[q] = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == truth


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).collect() == []
    assert nearest(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).collect() == []


def test_recall_on_the_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = sorted(rows)
    x = np.stack([rows[i] for i in ids])
    hits = total = 0
    found: dict[int, set] = {}
    for r in nearest(df, lambda i: i % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - float(rows[r.query_id] @ rows[r.vec_id])) < 1e-9
    for q in (i for i in ids if i % 20 == 0):
        order = [ids[j] for j in np.argsort(-(x @ rows[q]), kind="stable") if ids[j] != q][:20]
        hits, total = hits + len(found[q] & set(order)), total + 20
    assert hits >= 0.9 * total


def test_a_long_vector_leaves_the_others_alone(spark, sf_dir):
    """Lengths of all orders beside vectors of length one: recall stays, scores are exact."""
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    size = len(rows[0][1])
    rng = np.random.default_rng(2)
    rows += [(10**6 + i, (rng.normal(size=size) * scale).tolist()) for i, scale in enumerate([1e4, 1e-4, 1e30, 1e-30, 3e2, 1e9])]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=20).collect()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        truth = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = {r.vec_id for r in found if r.query_id == ids[q]}
        hits, total = hits + len(mine & truth), total + 20
    assert hits >= 0.95 * total
