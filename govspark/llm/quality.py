"""Quality classification by co-training of two views.

The text view sees shares and counts of the whole text, the metadata view the columns beside it. Both start from the
labelled documents. In each round each view scores all unlabelled documents and hands those it is sure of to the
other view as pseudo-labels of a lower weight. At the end a small calibration, fitted on labelled documents that neither
view was trained on, combines the two views' log-odds into one probability for every document.

Features of all documents are stored once; every fit is a distributed job over them. The labelled documents used are
at most ``MAX_LABELLED`` (by hash of the key, so the same ones for the same table); pseudo-labels, scores and features
cover all documents.

Defined results: a null or blank text has features of zero; null metadata is a value of its own; several labels of one
key count by majority, a tie as good, and null labels not at all; without labels of both kinds nothing is known, the
score is null and everything is kept; repeated rows come out as often as they go in. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.words import HASHED_BYTES, map_texts, parts, split_words, text_buffers
from govspark.scratch import settle

#: Labelled documents used at most.
MAX_LABELLED = 200_000
ROUNDS = 2
#: A view is sure from this probability on; pseudo-labels weigh less than labels.
SURE = 0.98
PSEUDO_WEIGHT = 0.3
#: Of 10 labelled documents so many are kept from training for calibration.
CALIBRATION_TENTHS = 3
THRESHOLD = 0.5
META_WIDTH = 1 << 12

_NEWLINE = np.zeros(256, bool)
_NEWLINE[[0x0A, 0x0D]] = True
_BYTES = np.arange(256)
_KINDS = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90),  # capitals
    (_BYTES >= 48) & (_BYTES <= 57),  # digits
    np.isin(_BYTES, list(b".,")),
    np.isin(_BYTES, list(b"!?")),
    np.isin(_BYTES, list(b"|#$%&*+=<>{}[]@^~_\\/")),
    np.isin(_BYTES, list(b"\n\r\t")),
    _BYTES >= 0x80,
])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=len(first) - 1)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of shares and logarithms per text."""
    words = split_words(texts)
    offsets = text_buffers(texts)[1]
    size = np.maximum(1, np.diff(offsets))
    n = np.diff(words.first)
    some = np.maximum(1, n)
    lengths, hashes = words.ends - words.starts, words.hashes()
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    lines = split_words(texts, separator=_NEWLINE)
    n_lines = np.diff(lines.first)
    capitals = _KINDS[0][words.data[words.starts]] if len(words.starts) else np.empty(0, bool)
    columns = [
        np.log1p(n), np.log1p(n_lines), _sums(lengths, words.first) / some, _sums(lengths <= 3, words.first) / some, _sums(lengths > 12, words.first) / some,
        _sums(capitals, words.first) / some, _sums(again, words.first) / some, _distinct(hashes, words.first) / some,
        _distinct(lines.hashes(), lines.first) / np.maximum(1, n_lines), n / np.maximum(1, n_lines) / 100,
        *(_sums(kind[words.data], offsets) / size for kind in _KINDS),
    ]
    table = np.stack(columns, 1)
    table[n == 0] = 0
    return table


def features(docs: DataFrame, key: str, text: str, metadata: list[str], length: str | None) -> DataFrame:
    """(doc, x: text view, m_*: metadata view as texts)."""
    plain = docs.select(
        docs[key].alias("doc"), docs[text].cast("string").alias("body"),
        *(F.coalesce(docs[c].cast("string"), F.lit("\0null")).alias(f"m_{i}") for i, c in enumerate(metadata)),
        *([F.coalesce(F.floor(F.log2(docs[length] + 1) * 2).cast("string"), F.lit("\0null")).alias("m_size")] if length else []),
    )
    names = plain.columns[2:]
    kind = dict(plain.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit=HASHED_BYTES):
                table = text_features(part.column("body"))
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc"), x, *(part.column(c) for c in names)], names=["doc", "x", *names])

    return map_texts(plain, run, f"doc {kind}, x array<double>, " + ", ".join(f"{c} string" for c in names))


def _fit(rows: DataFrame, view: str):
    return LogisticRegression(featuresCol=view, labelCol="y", weightCol="w", maxIter=25, regParam=1e-4).fit(rows.select(view, "y", "w"))


def _logit(model, rows: DataFrame, view: str, out: str) -> DataFrame:
    scored = model.setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    return scored.withColumn(out, vector_to_array("_raw")[1]).drop("_raw")


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    metadata: tuple[str, ...] = ("lang", "source"), length: str | None = "n_chars", rounds: int = ROUNDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: key, text_score and meta_score (log-odds of good), score (calibrated probability), keep."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc"))
    known = known.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    base = features(docs, key, text, list(metadata), length)
    names = base.columns[2:]
    hashed = FeatureHasher(inputCols=names, outputCol="meta", numFeatures=META_WIDTH).transform(base.withColumn("view", array_to_vector("x")))
    rows = settle(hashed.select("doc", "view", "meta").join(known, "doc", "left"), "features")

    draw = F.xxhash64("doc", F.lit("co-training"))
    total = rows.filter("y IS NOT NULL").count()
    share = min(1.0, MAX_LABELLED / total) if total else 0.0
    drawn = F.col("y").isNotNull() & (F.pmod(draw, F.lit(1_000_000)) < int(share * 1_000_000))
    labelled = rows.filter(drawn)
    held = F.pmod(F.xxhash64("doc", F.lit("held")), F.lit(10)) < CALIBRATION_TENTHS
    train = labelled.filter(~held).withColumn("w", F.lit(1.0))
    kinds = {(r.h, r.y) for r in labelled.select(held.alias("h"), "y").distinct().collect()}
    if len(kinds) < 4:
        unknown = F.lit(None).cast("double")
        return docs.select(key, unknown.alias("text_score"), unknown.alias("meta_score"), unknown.alias("score"), F.lit(True).alias("keep"))

    text_model, meta_model = _fit(train, "view"), _fit(train, "meta")
    line = float(np.log(SURE / (1 - SURE)))
    for _ in range(rounds):
        both = _logit(meta_model, _logit(text_model, rows.filter("y IS NULL"), "view", "t"), "meta", "m")
        pseudo = lambda by: both.filter(F.abs(by) >= line).select("view", "meta", (F.col(by) > 0).cast("double").alias("y"), F.lit(PSEUDO_WEIGHT).alias("w"))
        own = train.select("view", "meta", "y", "w")
        text_model, meta_model = _fit(own.unionByName(pseudo("m")), "view"), _fit(own.unionByName(pseudo("t")), "meta")

    scored = _logit(meta_model, _logit(text_model, rows, "view", "t"), "meta", "m").withColumn("both", array_to_vector(F.array("t", "m")))
    combine = _fit(scored.filter(drawn & held).withColumn("w", F.lit(1.0)), "both")
    final = _logit(combine, scored, "both", "z").withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    return final.select(F.col("doc").alias(key), F.col("t").alias("text_score"), F.col("m").alias("meta_score"), F.col("p").alias("score"), (F.col("p") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose key is not rejected. A row without a key is scored, but no rejection can name it: it stays."""
    rejected = settle(score(docs, labels, key, **how).filter("NOT keep").select(key).distinct(), "rejected")
    return docs.join(rejected, key, "left_anti")
