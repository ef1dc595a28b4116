"""Approximate nearest neighbours by inner product: a navigable small-world graph with levels for each shard.

Equal vectors are one node, so that any number of copies neither costs nor crowds the graph; of each class the smallest ids
are kept, as many as a result can name. Shards are dealt by length, to a power of two, and hash of the vector, and bounded in
size; a shard's graph is stored as one row of flat arrays (ids, vectors, neighbours of each level). Inner products become angles by one more
coordinate that gives all vectors of a shard one length. Nodes are inserted in batches: a batch looks for neighbours in
the graph so far and within itself, keeps diverse ones, and links back. Queries walk all graphs of a shard together, in
slices of bounded size; shard results are merged by score in double precision on the original vectors, ties by id.

Defined results: vectors that are null, empty or zero or hold a null or non-finite component take no part; vectors of
different lengths are never compared; repeated rows of one id and vector count once; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govspark.scratch import settle

#: Nodes of a shard at most on average (about 100 bytes of links and 4 bytes a coordinate each), and shards at least.
SHARD_NODES = 100_000
LEAST_SHARDS = 4
#: Nodes below which a shard is not cut for the sake of more tasks.
SMALL_SHARD = 64
#: Queries that meet a shard's graph in one group.
SLICE_QUERIES = 100_000
NEIGHBOURS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 128
#: One node in so many is also on the next level.
LEVEL_RATIO = 16
_CELLS = 32_000_000


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes met from ``entry`` (queries x any) for all queries at once: (ids or -1, scores)."""
    m, at_once = len(queries), 4
    seen = np.zeros((m, n + 1), bool)
    rows = np.arange(m)[:, None]
    ids = np.full((m, width), -1, np.int32)
    scores = np.full((m, width), -np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    fresh = entry
    live = np.arange(m)
    while True:
        # of a row's nodes each unseen one once; node n stands for none
        fresh = np.where(fresh < 0, n, fresh)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh[seen[live[:, None], fresh]] = n
        seen[live[:, None], fresh] = True
        seen[live, n] = True
        got = np.einsum("qkd,qd->qk", vectors[np.minimum(fresh, n - 1)], queries[live], optimize=True)
        got[fresh == n] = -np.inf
        all_ids = np.concatenate([ids[live], fresh], 1)
        all_scores = np.concatenate([scores[live], got], 1)
        all_open = np.concatenate([open_[live], fresh < n], 1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        r = rows[: len(live)]
        ids[live], scores[live], open_[live] = all_ids[r, best], all_scores[r, best], all_open[r, best] & np.isfinite(all_scores[r, best])
        waiting = np.where(open_[live], scores[live], -np.inf)
        going = np.isfinite(waiting).any(axis=1)
        live, waiting = live[going], waiting[going]
        if not len(live):
            break
        take = np.argpartition(-waiting, min(at_once, width) - 1, axis=1)[:, :at_once]
        r = rows[: len(live)]
        valid = np.isfinite(waiting[r, take])
        nodes = np.where(valid, ids[live[:, None], take], -1)
        open_[live[:, None], take] = False
        fresh = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return ids[rows, order], scores[rows, order]


def _diverse(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (-1: none) up to ``keep``: best first, each nearer to the row than to any kept one."""
    ids = np.where(candidates < 0, 0, candidates)
    near = vectors[ids]
    score = np.einsum("qkd,qd->qk", near, own, optimize=True)
    score[candidates < 0] = -np.inf
    order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * keep]
    r = np.arange(len(own))[:, None]
    ids, score, near = candidates[r, order], score[r, order], near[r, order]
    between = near @ near.transpose(0, 2, 1)
    out = np.full((len(own), keep), -1, np.int32)
    count = np.zeros(len(own), np.int64)
    crowd = np.full(score.shape, -np.inf, np.float32)
    for c in range(score.shape[1]):
        good = np.flatnonzero(np.isfinite(score[:, c]) & (score[:, c] > crowd[:, c]) & (count < keep))
        out[good, count[good]] = ids[good, c]
        count[good] += 1
        crowd[good] = np.maximum(crowd[good], between[good, c])
    # what room is left goes to the nearest of the others, which keeps the graph connected in dense places
    for c in range(score.shape[1]):
        rest = np.flatnonzero((count < keep) & np.isfinite(score[:, c]))
        rest = rest[~(out[rest] == ids[rest, c][:, None]).any(axis=1)]
        out[rest, count[rest]] = ids[rest, c]
        count[rest] += 1
    return out


def _chunks(total: int, width: int):
    step = max(1, _CELLS // max(1, width))
    for a in range(0, total, step):
        yield a, min(total, a + step)


def lengthen(vectors: np.ndarray) -> np.ndarray:
    """Vectors by one common factor of about unit size, with one more coordinate that gives all of them one length."""
    if not len(vectors):
        return np.empty((0, vectors.shape[1] + 1), np.float32)
    scaled = vectors / np.abs(vectors).max()
    norms = np.einsum("ij,ij->i", scaled, scaled, dtype=np.float64)
    rest = np.sqrt(np.maximum(0, norms.max() - norms))
    return (np.concatenate([scaled, rest[:, None]], 1) / np.sqrt(norms.max())).astype(np.float32)


def build_graph(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(order of nodes, lengthened vectors in that order, links per level from 0 up).

    Level l holds a prefix of the order, a sixteenth of the level below it; the last level has few nodes.
    """
    long = lengthen(vectors)
    order = np.random.default_rng(seed).permutation(len(long))
    long = long[order]
    sizes = [len(long)]
    while sizes[-1] > 64:
        sizes.append(max(1, sizes[-1] // LEVEL_RATIO))
    levels: list[np.ndarray] = [np.empty((0, 0), np.int32)] * len(sizes)
    for level in range(len(sizes) - 1, -1, -1):
        n, width = sizes[level], NEIGHBOURS * (2 if level == 0 else 1)
        links = np.full((n, width), -1, np.int32)
        done = 0
        while done < n:
            stop = min(n, done + max(64, min(4096, done // 2)))
            batch = np.arange(done, stop)
            found = [np.full((len(batch), 0), -1, np.int32)]
            if done:
                parts = []
                for a, b in _chunks(len(batch), done):
                    entry = descend(long, levels, long[batch[a:b]], level, sizes, done)
                    parts.append(_beam(long, links, long[batch[a:b]], entry, BUILD_BEAM, done)[0])
                found.append(np.concatenate(parts))
            inner = long[batch] @ long[batch].T
            np.fill_diagonal(inner, -np.inf)
            k = min(len(batch) - 1, NEIGHBOURS)
            if k:
                found.append((np.argpartition(-inner, k - 1, axis=1)[:, :k] + done).astype(np.int32))
            candidates = np.concatenate(found, 1)
            chosen = _diverse(long, long[batch], candidates, NEIGHBOURS) if candidates.shape[1] else np.full((len(batch), NEIGHBOURS), -1, np.int32)
            links[done:stop, :NEIGHBOURS] = chosen
            source, slot = np.nonzero(chosen >= 0)
            _link_back(long, links, chosen[source, slot], batch[source], width)
            done = stop
        levels[level] = links
    return order, long, levels


def _link_back(vectors: np.ndarray, links: np.ndarray, to: np.ndarray, new: np.ndarray, width: int) -> None:
    """Adds ``new`` to the lists of ``to``; full lists keep a diverse choice."""
    score = np.einsum("ij,ij->i", vectors[to], vectors[new])
    order = np.lexsort((-score, to))
    to, new = to[order], new[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, counts)
    wide = min(int(counts.max(initial=0)), width)
    inside = place < wide
    arrivals = np.full((len(targets), wide), -1, np.int32)
    arrivals[np.repeat(np.arange(len(targets)), counts)[inside], place[inside]] = new[inside]
    for a, b in _chunks(len(targets), 4 * width * vectors.shape[1]):
        both = np.concatenate([links[targets[a:b]], arrivals[a:b]], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        links[targets[a:b]] = _diverse(vectors, vectors[targets[a:b]], both, width)


def descend(vectors, levels, queries, level: int, sizes: list[int], inserted: int) -> np.ndarray:
    """Entry nodes on ``level`` for each query, found on the levels above."""
    entry = np.zeros((len(queries), 1), np.int32)
    for upper in range(len(sizes) - 1, level, -1):
        entry = _beam(vectors, levels[upper], queries, entry, 8, sizes[upper])[0]
    return np.where(entry < inserted, entry, 0)


def search_graph(long: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
    """Nodes (or -1), best first."""
    sizes = [len(links) for links in levels]
    longer = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
    out = [np.full((0, max(beam, k)), -1, np.int32)]
    for a, b in _chunks(len(queries), sizes[0]):
        entry = descend(long, levels, longer[a:b], 0, sizes, sizes[0])
        out.append(_beam(long, levels[0], longer[a:b], entry, max(beam, k), sizes[0])[0])
    return np.concatenate(out)[:, :k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_INDEX = "dim int, shard int, ids binary, vectors binary, sizes array<int>, links array<binary>"


def _build(group: pa.Table) -> pa.Table:
    dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
    vectors = _matrix(group.column("vector"), dim).astype(np.float64)
    order, _, levels = build_graph(vectors)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
        "ids": [group.column("node").to_numpy()[order].astype(np.int64).tobytes()], "vectors": [vectors[order].tobytes()],
        "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())), "links": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
    })


def _search(k: int, beam: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [np.empty(0, np.int64)], "node": [np.empty(0, np.int64)], "score": [np.empty(0, np.float64)]}
        if index.num_rows and queries.num_rows:
            dim = index.column("dim")[0].as_py()
            ids = np.frombuffer(index.column("ids")[0].as_py(), np.int64)
            vectors = np.frombuffer(index.column("vectors")[0].as_py(), np.float64).reshape(-1, dim)
            levels = [np.frombuffer(x, np.int32).reshape(n, -1) for n, x in zip(index.column("sizes")[0].as_py(), index.column("links")[0].as_py())]
            wanted = _matrix(queries.column("vector"), dim).astype(np.float64)
            found = search_graph(lengthen(vectors), levels, wanted / np.abs(wanted).max(axis=1, keepdims=True), k, beam)
            q, slot = np.nonzero(found >= 0)
            nodes = found[q, slot]
            out["query_id"].append(queries.column("query_id").to_numpy()[q])
            out["node"].append(ids[nodes])
            out["score"].append(np.einsum("ij,ij->i", vectors[nodes], wanted[q]))
        return pa.table({name: np.concatenate(x) for name, x in out.items()})

    return run


def _magnitude(vector):
    """The power of two next to a vector's length. Vectors of one shard share it, so that no long one blurs the others."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / largest) * (x / largest))
    return F.round(F.log2(largest) + F.log2(squares) / 2).cast("int")


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles, dim) of the vectors that take part."""
    v = F.col("vector")
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < limit) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine).select("id", "vector", F.size("vector").alias("dim")).dropDuplicates(["id"])


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that ``is_query`` (a column of ``key``) the k nearest other rows found."""
    rows = settle(usable(vectors, key, vector), "vectors")
    # of equal vectors a result names k ids at most, and one more may be the query's own
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("_r") <= k + 1)
    first = F.min("id").over(Window.partitionBy("vector"))
    members = settle(ranked.withColumn("node", first), "classes")
    nodes = members.filter("_r = 1")
    sizes = {r.magnitude: r.n for r in nodes.groupBy(_magnitude(F.col("vector")).alias("magnitude")).agg(F.count("*").alias("n")).collect()}
    parts, shards = {}, 0
    for magnitude, n in sorted(sizes.items()):
        parts[magnitude] = (shards, max(LEAST_SHARDS if n > LEAST_SHARDS * SMALL_SHARD else 1, -(-n // SHARD_NODES)))
        shards += parts[magnitude][1]
    of = F.create_map(*(x for m, (first, n) in parts.items() for x in (F.lit(m), F.lit(first * 2**31 + n).cast("long"))))[_magnitude(F.col("vector"))] if parts else F.lit(1)
    shard = F.shiftright(of, 31) + F.pmod(F.xxhash64("vector"), of.bitwiseAND(F.lit(2**31 - 1)))
    dealt = nodes.select("dim", shard.cast("int").alias("shard"), "node", "vector")
    index = settle(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "graphs")

    queries = rows.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "vector", "dim")
    slices = max(1, -(-queries.count() // SLICE_QUERIES))
    placed = queries.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))))
    copies = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    groups = ["dim", "shard", "slice"]
    hits = copies.groupBy(*groups).cogroup(placed.groupBy(*groups)).applyInArrow(_search(k + 1, beam), "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    top = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    named = top.join(members.select("node", "id"), "node").filter("id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return named.select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias("vec_id"), "score").filter(F.col("rank") <= k)
