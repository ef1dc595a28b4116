"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

Texts are lower-cased; ASCII characters other than letters all count as one boundary sign. Characters are hashed in runs of 1
to ``WIDTHS`` to 2^``BITS`` features; a feature's weight in a text is its share of the text's n-grams times log(N / df).

1. *Statistics.* Document frequencies are counted over all learnable texts, whole.
2. *Learning.* Follow-the-regularised-leader with an L1 and an L2 penalty, in several rounds: every partition goes on from
   the common state over its rows, and the states are averaged, weighted by rows. It learns from a bounded sample of about
   ``PER_LANGUAGE`` texts of each language, dealt out by the hash of the key.
3. *Calibration.* One temperature divides the scores; it is fitted on sampled texts that learning never saw.
4. *Prediction.* Of all texts, whole. Weights are linear in the n-grams, so a text costs a sum over its characters.

The model, at most ``2^BITS`` features times languages, is all that comes to the driver or travels to tasks.

Defined results: a text that is null or has no letter is ``und`` with score 0; without anything to learn from every text is.
Rows come out as often as they go in, null keys included. Only ``text`` enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.words import mix, parts, text_buffers
from govspark.scratch import settle

BITS = 17
WIDTHS = 3
#: Texts of a language that are learned from at most, in expectation, and partitions and rounds of learning.
PER_LANGUAGE = 3000
PARTITIONS = 8
ROUNDS = 3
#: Follow the regularised leader: step size, its offset, and the penalties of absolute and squared weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Weights are shares of a text; this brings them to the order of one.
SCALE = 30.0
TEMPERATURES = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.zeros(128, np.uint32)
_PLAIN[97:123] = np.arange(97, 123)


def features(texts: pa.Array, bits: int = BITS, widths: int = WIDTHS) -> tuple[np.ndarray, np.ndarray]:
    """(features of all n-grams of all texts, where each text begins in them); a null is empty."""
    data, offsets = text_buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    if not len(data):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    if data.max() < 0x80:
        codes, first = _PLAIN[data], offsets
    else:
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    length = np.diff(first)
    # a text of n characters has its n, n - 1, ... n-grams one width after another
    sizes = np.maximum(length[:, None] - np.arange(widths), 0)
    bounds = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int64)
    places = bounds[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    out = np.empty(bounds[-1], np.uint32)
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(codes)) - first[owner]
    left = length[owner] - inside
    rolled = np.zeros(len(codes), np.uint64)
    for width in range(widths):
        n = len(codes) - width
        if n <= 0:
            break
        rolled = rolled[:n] * _STEP + codes[width:] + np.uint64(1)
        whole = left[:n] > width
        out[(places[:, width][owner[:n]] + inside[:n])[whole]] = (mix(rolled + np.uint64(width))[whole] >> np.uint64(64 - bits)).astype(np.uint32)
    return out, bounds


@dataclass
class Model:
    """``weights[feature, language]`` are TF-IDF weights and logistic weights in one."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        found, bounds = features(texts)
        size = np.diff(bounds)
        total = np.zeros((len(size), len(self.languages)))
        filled = np.flatnonzero(size)
        if len(filled):
            total[filled] = np.add.reduceat(self.weights[found], bounds[:-1][filled], axis=0, dtype=np.float64) / size[filled, None]
        return total + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that hold each feature, texts in all), over all of them; the vector has 2^BITS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, stamp = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in parts(batch):
                found, bounds = features(part.column("body"))
                for a, b in zip(bounds, bounds[1:]):
                    one, number = found[a:b], np.arange(b - a)
                    stamp[one] = number
                    df[one[stamp[one] == number]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["feature", "df"])

    counted = texts.select("body").mapInArrow(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    out = np.zeros(1 << BITS, np.int64)
    rows = counted.toArrow()
    out[rows.column("feature").to_numpy()] = rows.column("df").to_numpy()
    return out, texts.count()


class Leader:
    """State of follow-the-regularised-leader with averaged gradients kept per weight; row 2^BITS is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    @staticmethod
    def start(languages: int) -> Leader:
        return Leader(np.zeros(((1 << BITS) + 1, languages)), np.zeros(((1 << BITS) + 1, languages)))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One text: its distinct features and their weights, the bias among them."""
        w = self.weights(at)
        p = softmax((x[None, :] @ w))[0]
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _examples(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    found, bounds = features(texts)
    for a, b in zip(bounds, bounds[1:]):
        at, counts = np.unique(found[a:b], return_counts=True)
        yield np.append(at, 1 << BITS), np.append(SCALE * counts / max(1, b - a) * idf[at], 1.0)


def _round(rows: DataFrame, leader: Leader, idf: np.ndarray) -> Leader:
    """Every partition goes on from the same state; the mean of their states, by rows."""
    languages = leader.z.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Leader(leader.z.copy(), leader.n.copy()), 0
        for batch in batches:
            for part in parts(batch):
                for (at, x), label in zip(_examples(part.column("body"), idf), part.column("label").to_pylist()):
                    own.learn(at, x, label)
                    seen += 1
        if seen:
            moved = np.flatnonzero((own.n != leader.n).any(axis=1))
            changes = np.concatenate([own.z[moved] - leader.z[moved], own.n[moved] - leader.n[moved]], axis=1) * seen
            lists = pa.FixedSizeListArray.from_arrays(pa.array(changes.ravel()), 2 * languages).cast(pa.list_(pa.float64()))
            moved, lists = pa.array(np.append(moved, -1).astype(np.int32)), pa.concat_arrays([lists, pa.array([[float(seen)] * 2 * languages], pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays([moved, lists], names=["feature", "change"])

    sums = [F.sum(F.col("change")[i]).alias(f"c{i}") for i in range(2 * languages)]
    total = rows.mapInArrow(run, "feature int, change array<double>").groupBy("feature").agg(*sums).toArrow()
    at = total.column("feature").to_numpy()
    change = np.stack([total.column(f"c{i}").to_numpy() for i in range(2 * languages)], 1)
    seen = change[at < 0][0, 0]
    z, n = leader.z.copy(), leader.n.copy()
    z[at[at >= 0]] += change[at >= 0][:, :languages] / seen
    n[at[at >= 0]] += change[at >= 0][:, languages:] / seen
    return Leader(z, n)


def _temperature(rows: DataFrame, model: Model) -> float:
    """The temperature of the least log loss; every partition adds up the loss at each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for part in parts(batch):
                logits, labels = model.logits(part.column("body")), part.column("label").to_numpy()
                for i, temperature in enumerate(TEMPERATURES):
                    scaled = logits / temperature
                    top = scaled.max(axis=1)
                    loss[i] += (top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss)).astype(np.int32)), pa.array(loss)], names=["i", "loss"])

    found = rows.mapInArrow(run, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    loss = {r.i: r.loss for r in found}
    if not any(loss.values()):
        return 1.0
    return float(TEMPERATURES[min(loss, key=lambda i: (loss[i], i))])


def has_letter(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"\p{L}")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the texts of ``docs`` that have a language and a letter; None if there are none."""
    plain = docs.select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("body"), docs[lang].cast("string").alias("lang"))
    plain = plain.filter(F.col("lang").isNotNull() & has_letter(F.col("body")))
    known = {r.lang: r.n for r in plain.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the labels, a closed list
    if not known:
        return None
    languages = sorted(known)
    df, n = _document_frequencies(plain)
    idf = np.log((1.0 + n) / (1.0 + df))
    # a share of each language, by the key's hash: some tens of thousands of texts at any size of the corpus
    share = F.create_map(*(F.lit(v) for name in languages for v in (name, min(1.0, per_language / known[name]))))
    label = F.create_map(*(F.lit(v) for i, name in enumerate(languages) for v in (name, i)))
    chance = F.pmod(F.xxhash64("key", "body"), F.lit(1 << 40)) / float(1 << 40)
    sample = plain.withColumn("chance", chance).filter(F.col("chance") < share[F.col("lang")])
    sample = settle(sample.select("chance", "body", label[F.col("lang")].alias("label"), (F.pmod(F.xxhash64("body"), F.lit(10)) == 0).alias("calibrates")), "language-sample")
    rows = sample.filter("NOT calibrates")
    if not rows.limit(1).count():
        rows = sample
    leader = Leader.start(len(languages))
    for i in range(ROUNDS):
        dealt = F.xxhash64(F.lit(i), "chance")
        leader = _round(rows.repartition(PARTITIONS, dealt).sortWithinPartitions(dealt, "body"), leader, idf)
    w = leader.weights()
    model = Model(languages, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1])
    model.temperature = _temperature(sample.filter("calibrates"), model)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``kept`` columns of all rows, lang_pred and score."""
    plain = docs.select(*(docs[c].alias(f"kept_{i}") for i, c in enumerate(kept)), docs[text].cast("string").alias("body"))
    plain = plain.withColumn("known", has_letter(F.col("body")))
    fields = [T.StructField(f"kept_{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                known = np.array(part.column("known")) & (model is not None)
                names, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if known.any():
                    chances = model.probabilities(part.column("body").filter(pa.array(known)))
                    names[known], score[known] = np.array(model.languages, object)[chances.argmax(axis=1)], chances.max(axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    found = plain.mapInArrow(run, schema)
    return found.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)), "lang_pred", "score")
