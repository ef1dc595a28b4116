"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

A document is its lower-cased words and one end sign; the word before the first is a begin sign. With D(c) the modified
discounts of counts 1, 2 and 3 or more,

    P(w | v) = (c(v w) - D(c(v w))) / c(v .) + (D1 N1(v .) + D2 N2(v .) + D3 N3+(v .)) / c(v .) * P(w)
    P(w)     = (N1+(. w) - D'(N1+(. w))) / N1+(. .) + (share of the mass the discounts D' take) / (V + 1)

where N1+(. w) is the number of different words before w; an unknown word has the last term only, and after an unknown
word P(w) is used. Discounts follow from the counts of counts of all documents.

Tasks add up their own bigrams before they are shuffled by first word. A bucket is a function of the first word, and for
short words, the frequent ones of any language, of the second word too, so that no word fills a task. The task that has
all rows of a bucket writes it as one file of sorted 64-bit hashes and counts; word statistics are added up once more and
written the same way. Every worker maps the files it meets, so the operating system shares one copy per machine, and looks
up a batch's distinct bigrams in order. The model grows with the corpus and is nowhere held in memory as a whole.

The folder must be one that all machines mount (``spark.checkpoint.dir`` as a path or file: URL), as memory mapping needs files.

Defined results: a null or blank text is the end sign alone; repeated rows count and come out as often as they go in; an empty
training part gives every token 1 / (V + 1) with V = 0, and a base score of null; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.tables import plain_docs
from govspark.llm.words import mix, parts, split_words
from govspark.scratch import run_dir, settle

BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
#: Words of up to so many bytes are dealt out by the next word too, into so many parts.
SHORT_BYTES, SHORT_PARTS = 4, 32
#: Text (bytes) whose bigrams a task adds up before it hands them on.
COMBINE_BYTES = 32 << 20
#: A bigram's count takes one byte; from this number on it stands in a file of its own beside.
LARGE = 255
#: Buckets of the model per partition of the input.
BUCKETS_PER_PART = 2


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hashes before them, is the one before short, where each text begins)."""
    words = split_words(texts, lower=True)
    n = len(words.first) - 1
    sizes = np.diff(words.first)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    token = np.empty(first[-1], np.uint64)
    short = np.zeros(first[-1], bool)
    place = np.arange(len(words.starts)) + np.repeat(np.arange(n), sizes)
    token[place] = words.hashes()
    short[place] = words.ends - words.starts <= SHORT_BYTES
    token[first[1:] - 1] = END
    before, short_before = np.empty_like(token), np.ones_like(short)
    before[1:], short_before[1:] = token[:-1], short[:-1]
    before[first[:-1]], short_before[first[:-1]] = BEGIN, True
    return token, before, short_before, first


def _bucket(before: np.ndarray, token: np.ndarray, short: np.ndarray, buckets: int) -> np.ndarray:
    spread = np.where(short, token % np.uint64(SHORT_PARTS), 0).astype(np.uint64)
    return (mix(before + spread * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _bigrams(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, v, w, c), added up within a task's batches."""

    def added(kept: list[tuple]) -> pa.RecordBatch:
        before, token, short = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((token, before))
        before, token, short = before[order], token[order], short[order]
        new = np.ones(len(token), bool)
        new[1:] = (before[1:] != before[:-1]) | (token[1:] != token[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(token)))
        v, w = before[at], token[at]
        columns = [_bucket(v, w, short[at], buckets), v.view(np.int64), w.view(np.int64), counts]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "v", "w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for part in parts(batch):
                token, before, short, _ = _tokens(part.column("body"))
                kept.append((before, token, short))
                size += part.column("body").nbytes
                if size >= COMBINE_BYTES:
                    yield added(kept)
                    kept, size = [], 0
        if kept:
            yield added(kept)

    return docs.mapInArrow(run, "bucket int, v long, w long, c long")


def _write(folder: str, name: str, bucket: int, **columns: np.ndarray) -> None:
    """One file per column; a repeated task writes the same again, and a reader never sees half a file."""
    for column, values in columns.items():
        path = f"{folder}/{name}-{bucket}-{column}.npy"
        draft = f"{path}.{uuid.uuid4().hex}"
        with open(draft, "wb") as file:
            np.save(file, values)
        os.replace(draft, path)


def _store_bigrams(bigrams: DataFrame, folder: str) -> DataFrame:
    """Writes the buckets and gives the statistics of words: (key, c, before, total, n1, n2, n3, e3, e4)."""

    def statistics(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        first, inverse = np.unique(v, return_inverse=True)
        count = lambda which: np.bincount(inverse, which, minlength=len(first)).astype(np.int64)
        second, back = np.unique(w, return_inverse=True)
        zeros = np.zeros(len(first), np.int64)
        none = np.zeros(len(second), np.int64)
        left = [first.view(np.int64), zeros, zeros, count(c), count(c == 1), count(c == 2), count(c >= 3), count(c == 3), count(c == 4)]
        right = [second.view(np.int64), np.bincount(back, c).astype(np.int64), np.bincount(back).astype(np.int64), *[none] * 6]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(left, right)], names=_STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[b.column(i).to_numpy() for i in range(4)] for b in batches if b.num_rows]
        if not kept:
            return
        bucket, v, w, c = (np.concatenate(x) for x in zip(*kept))
        del kept
        v, w = v.view(np.uint64), w.view(np.uint64)
        pairs = _pair(v, w)
        order = np.lexsort((pairs, bucket))
        marks = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[order], [-1]])))
        for a, b in zip(marks, marks[1:]):
            rows = order[a:b]
            _write(folder, "pair", int(bucket[rows[0]]), key=pairs[rows], c=np.minimum(c[rows], LARGE).astype(np.uint8))
            rows = rows[c[rows] >= LARGE]
            if len(rows):
                _write(folder, "large", int(bucket[rows[0]]), key=pairs[rows], c=c[rows])
        yield statistics(v, w, c)

    return bigrams.mapInArrow(run, ", ".join(f"{name} long" for name in _STATISTICS))


_STATISTICS = ["key", "c", "before", "total", "n1", "n2", "n3", "e3", "e4"]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts; where a count of counts is zero, those of absolute discounting by one half."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))


def _discount(counts, d: tuple[float, float, float]):
    if isinstance(counts, Column):
        return F.when(counts == 0, 0.0).when(counts == 1, d[0]).when(counts == 2, d[1]).otherwise(d[2])
    return np.where(counts == 0, 0.0, np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])))


def local_folder(spark: SparkSession) -> str:
    """A fresh folder that workers can map files from."""
    path = run_dir(spark, "model")
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError("memory mapping needs spark.checkpoint.dir on a file system that all machines mount")
    os.makedirs(path, exist_ok=True)
    return path


def train(docs: DataFrame) -> dict:
    """Counts the documents (columns doc, body) and stores the model; the result says where it is and what its totals are."""
    spark = docs.sparkSession
    folder = local_folder(spark)
    buckets = max(8, BUCKETS_PER_PART * docs.rdd.getNumPartitions())
    bigrams = _bigrams(docs, buckets).repartition(buckets, "bucket").groupBy("bucket", "v", "w").agg(F.sum("c").alias("c"))
    sums = [F.sum(name).alias(name) for name in _STATISTICS[1:]]
    words = settle(_store_bigrams(bigrams, folder).groupBy("key").agg(*sums), "words")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))
    before = F.col("before")
    totals = words.agg(
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _STATISTICS[1:]), of(F.col("c") > 0).alias("words"),
        *(of(before == i).alias(f"b{i}") for i in (1, 2, 3, 4)), of(before >= 3).alias("b3p"),
    ).first().asDict()
    upper = _discounts(totals["n1"], totals["n2"], totals["e3"], totals["e4"])
    lower = _discounts(totals["b1"], totals["b2"], totals["b3"], totals["b4"])
    kinds = max(1, totals["before"])
    spare = (lower[0] * totals["b1"] + lower[1] * totals["b2"] + lower[2] * totals["b3p"]) / kinds if totals["before"] else 1.0
    unknown = spare / (totals["words"] + 1)
    alone = (before - _discount(before, lower)) / kinds + unknown
    weight = (upper[0] * F.col("n1") + upper[1] * F.col("n2") + upper[2] * F.col("n3")) / F.col("total")
    bucket = F.pmod(F.shiftrightunsigned("key", 8), F.lit(buckets)).cast("int")
    table = words.select(bucket.alias("bucket"), "key", "c", alone.alias("alone"), "total", F.when(F.col("total") > 0, weight).otherwise(1.0).alias("weight"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[b.column(i).to_numpy() for i in range(6)] for b in batches if b.num_rows]
        if kept:
            bucket, key, *values = (np.concatenate(x) for x in zip(*kept))
            key = key.view(np.uint64)
            order = np.lexsort((key, bucket))
            marks = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[order], [-1]])))
            for a, b in zip(marks, marks[1:]):
                rows = order[a:b]
                _write(folder, "word", int(bucket[rows[0]]), key=key[rows], **{n: v[rows] for n, v in zip(("c", "alone", "total", "weight"), values)})
            yield pa.RecordBatch.from_arrays([pa.array([len(key)])], names=["n"])

    table.repartition(buckets, "bucket").mapInArrow(store, "n long").agg(F.sum("n")).first()
    return {"folder": folder, "buckets": buckets, "discounts": upper, "unknown": unknown, "tokens": totals["c"], "words": totals["words"]}


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _lookup(model: dict, name: str, bucket: np.ndarray, key: np.ndarray, columns: dict[str, tuple[type, float]]) -> dict[str, np.ndarray]:
    """The values of keys, sorted by bucket and key; a default where a key is not stored."""
    out = {c: np.full(len(key), default, kind) for c, (kind, default) in columns.items()}
    marks = np.flatnonzero(np.diff(np.concatenate([[-1], bucket, [-1]])))
    for a, b in zip(marks, marks[1:]):
        stem = f"{model['folder']}/{name}-{bucket[a]}-"
        stored = _mapped(f"{stem}key.npy")
        if stored is None or not len(stored):
            continue
        at = np.minimum(np.searchsorted(stored, key[a:b]), len(stored) - 1)
        hit = np.flatnonzero(stored[at] == key[a:b])
        for c in columns:
            out[c][a + hit] = _mapped(f"{stem}{c}.npy")[at[hit]]
    return out


def score_batch(texts: pa.Array, model: dict) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, log10 probability by the base, by the model) of each text."""
    token, before, short, first = _tokens(texts)
    buckets = model["buckets"]
    # words: each distinct one once, in the order of the files
    word, inverse = np.unique(np.concatenate([token, before]), return_inverse=True)
    home = ((word >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((word, home))
    columns = {"c": (np.int64, 0), "alone": (np.float64, model["unknown"]), "total": (np.int64, 0), "weight": (np.float64, 1.0)}
    found = _lookup(model, "word", home[order], word[order], columns)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[inverse]
    w, v = at[: len(token)], at[len(token) :]
    pairs = _pair(before, token)
    _, once, back = np.unique(pairs, return_index=True, return_inverse=True)
    bucket = _bucket(before[once], token[once], short[once], buckets)
    order = np.lexsort((pairs[once], bucket))
    bucket, key = bucket[order], pairs[once][order]
    sorted_count = _lookup(model, "pair", bucket, key, {"c": (np.int64, 0)})["c"]
    large = np.flatnonzero(sorted_count == LARGE)
    sorted_count[large] = _lookup(model, "large", bucket[large], key[large], {"c": (np.int64, 0)})["c"]
    count = np.empty(len(once), np.int64)
    count[order] = sorted_count
    c = count[back]
    total = found["total"][v]
    seen = (c - _discount(c, model["discounts"])) / np.maximum(1, total)
    p = np.where(total > 0, seen + found["weight"][v] * found["alone"][w], found["alone"][w])
    n, vocabulary = model["tokens"], model["words"]
    counts = found["c"][w]
    base = np.log10((counts + 0.1) / (n + 0.1 * (vocabulary + 1)))
    add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.empty(0)
    return np.diff(first), add((counts > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the rows for which ``training``, a condition on ``docs``, holds.
    """
    model = train(plain_docs(docs.filter(training), key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                if not part.num_rows:
                    continue
                n, known, base, own = score_batch(part.column("body"), model)
                trained = np.full(len(n), model["tokens"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(n), pa.array(known), pa.array(trained), pa.array(base), pa.array(own)],
                    names=["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    plain = plain_docs(docs, key, text)
    out = plain.mapInArrow(run, "doc long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc", key).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
