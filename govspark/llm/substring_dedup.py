"""Repeated word spans by de Bruijn compaction.

A window is ``width`` consecutive words of one document, an edge of the de Bruijn graph between the (width - 1)-word nodes
at its ends. A node is straight when all its occurrences in the corpus have one and the same word before and one and
the same word after it; along straight nodes all edges occur at exactly the same places, so a path of them is compacted
into one row per occurrence, keyed by its first edge. The smallest document of a path is then the smallest document of
each of its windows, and the coordinates kept with every occurrence give the words to remove.

Most windows occur once, and the graph is built only of those that may repeat: two equal windows have the same smallest
hash among their ``seed``-word parts, so a window is left out when that smallest hash occurs in one document only. This
is a property of the window's words, so all occurrences of a window stay or go together.

A word, or a few, repeated over and over in one document would make one node occur any number of times there; such a run
is folded into a few rows that say how far it goes.

Exact copies are set apart first: all windows of a copy start in the first document of its class.

Defined results: a null or blank text has no words and nothing is removed; repeats inside one document are kept. A key
stands for one text: repeated rows of a key come out as often as they go in, with equal results; a row without a key
loses nothing and takes nothing. Other columns are not read. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.tables import broadcast_ids, not_null, plain_docs, required
from govspark.llm.words import HASHED_BYTES, Words, map_texts, parts, split_words, window_hashes
from govspark.scratch import settle

WIDTH = 13
SEED = 6
MIN_LONG = -(2**63)
_NONE = np.iinfo(np.uint64).max


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _window_minima(hashes: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest seed hash of each whole window, first word of each)."""
    seeds, at = window_hashes(hashes, first, seed)
    low = np.full(len(hashes) + width, _NONE, np.uint64)
    low[at] = seeds
    wide, need = 1, width - seed + 1
    while wide < need:  # minima over 1, 2, 4, ... and at last exactly ``need`` neighbours
        step = min(wide, need - wide)
        low = np.minimum(low[:-step], low[step:])
        wide += step
    sizes = np.diff(first)
    inside = np.arange(len(hashes)) - np.repeat(first[:-1], sizes)
    starts = np.flatnonzero(inside <= np.repeat(sizes, sizes) - width)
    return low[starts], starts


def _exact_copies(docs: DataFrame) -> DataFrame:
    """Documents whose text also belongs to a smaller key."""
    digest = docs.select("doc", F.xxhash64("body").alias("a"), F.xxhash64(F.lit(1), F.col("body")).alias("b"), F.octet_length("body").alias("n"))
    digest = digest.filter("n > 0")
    first = digest.groupBy("a", "b", "n").agg(F.min("doc").alias("first"), F.count("*").alias("m")).filter("m > 1")
    return digest.join(first, ["a", "b", "n"]).filter("doc > first").select("doc")


def _seed_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit=HASHED_BYTES):
                words = split_words(part.column("body"))
                low, starts = _window_minima(words.hashes(), words.first, width, seed)
                owner = words.document()[starts]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                yield required(low=_signed(low[new]), doc=part.column("doc").to_numpy()[owner[new]])

    return map_texts(docs, run, not_null(low="long", doc="long"))


def _fold_periods(nodes: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, ``last`` of each): what repeats with a short period inside one document becomes a few rows.

    Of a run with period q the first and the last period stay. One period in between stands for all others: its rows say
    where their last repetition is (``last``). The period after it only marks where paths end (``last`` is -1).
    """
    last, stay = at.copy(), np.ones(len(at), bool)
    free = np.ones(len(at), bool)
    for q in range(1, longest + 1):
        same = (nodes[q:] == nodes[:-q]) & (at[q:] - at[:-q] == q) & free[q:] & free[:-q]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            stop = b + q
            if stop - a < 6 * q:
                continue
            free[a:stop] = False
            middle = np.arange(a + q, a + 2 * q)
            last[middle] = at[middle + (stop - q - 1 - middle) // q * q]
            last[a + 2 * q : a + 3 * q] = -1
            stay[a + 3 * q : stop - q] = False
    return stay, last[stay]


def _node_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """One row per node beside a window that may repeat: the node, the words around it (0: none there), where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit=HASHED_BYTES):
                words = split_words(part.column("body"))
                hashes = words.hashes()
                low, starts = _window_minima(hashes, words.first, width, seed)
                shared = np.unique(part.column("lows").flatten().to_numpy())
                at = np.minimum(np.searchsorted(shared, low.view(np.int64)), max(len(shared) - 1, 0))
                live = starts[shared[at] == low.view(np.int64)] if len(shared) else starts[:0]
                after, before = np.zeros(len(hashes) + 1, bool), np.zeros(len(hashes) + 1, bool)
                after[live] = True
                before[live + 1] = True
                nodes, node_at = window_hashes(hashes, words.first, width - 1)
                used = after[node_at] | before[node_at]
                nodes, node_at = nodes[used], node_at[used]
                short = (hashes >> np.uint64(32)) | np.uint64(1)
                previous = np.where(before[node_at], short[node_at - 1], 0).astype(np.uint64)
                following = np.where(after[node_at], short[np.minimum(node_at + width - 1, len(short) - 1)], 0).astype(np.uint64) if len(node_at) else previous
                owner = words.document()[node_at]
                stay, last = _fold_periods(nodes, node_at, width - 1)
                nodes, node_at, previous, following, owner = (x[stay] for x in (nodes, node_at, previous, following, owner))
                yield required(
                    node=_signed(nodes),
                    around=_signed((previous << np.uint64(32)) | following),
                    doc=part.column("doc").to_numpy()[owner],
                    pos=(node_at - words.first[owner]).astype(np.int32),
                    last=np.where(last < 0, -1, last - words.first[owner]).astype(np.int32),
                )

    return map_texts(docs, run, not_null(node="long", around="long", doc="long", pos="int", last="int"))


def _repeated_paths(docs: DataFrame, originals: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc, start, stop, first_doc): words of paths that also occur in a smaller document; originals: no exact copies."""
    # one shuffle serves the counts and the join with them; columns that cannot be null keep it free of differing filters
    lows = _seed_rows(originals, width, seed).repartition("low")
    several = lows.groupBy("low").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("low")
    may_repeat = lows.join(several, "low").groupBy("doc").agg(F.collect_set("low").alias("lows"))
    nodes = _node_rows(docs.join(may_repeat, "doc"), width, seed).repartition("node")
    mask = F.lit(0xFFFFFFFF)
    straight = (
        nodes.groupBy("node")
        .agg(F.min("around").alias("a"), F.max("around").alias("b"), F.min("pos").alias("p"), F.min("last").alias("l"), F.max("doc").alias("d"))
        # p, l and d say nothing, but keep both readers of ``nodes`` at the same columns, so that they share one shuffle
        .filter((F.col("p") >= 0) & (F.col("l") >= -1) & (F.col("d") >= MIN_LONG) & (F.col("a") == F.col("b")) & (F.shiftrightunsigned("a", 32) != 0) & (F.col("a").bitwiseAND(mask) != 0))
        .select("node", F.lit(True).alias("straight"))
    )
    # plain joins: a semi or anti join would be pushed below the shuffle that is to be shared
    ends = nodes.join(straight, "node", "left").filter("straight IS NULL").withColumn("following", F.col("around").bitwiseAND(mask))
    paths = ends.withColumn("end", F.lead("pos").over(Window.partitionBy("doc").orderBy("pos"))).filter("following != 0 AND end > pos AND last >= 0")
    paths = paths.select("doc", "node", "following", "pos", (F.col("last") + F.col("end") - F.col("pos")).alias("end"))
    firsts = paths.groupBy("node", "following").agg(F.min("doc").alias("first_doc"), F.count("*").alias("m")).filter("m > 1")
    found = paths.join(firsts, ["node", "following"]).filter("first_doc < doc")
    return found.select("doc", F.col("pos").alias("start"), (F.col("end") + width - 1).alias("stop"), "first_doc")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per repeated path: key, words ``start`` to ``stop`` (exclusive), and the first document that has them.

    Exact copies are left out here; ``cut`` treats them as wholly repeated.
    """
    plain = plain_docs(docs, key, text).filter("doc IS NOT NULL")
    copies = settle(_exact_copies(plain), "copies")
    originals = plain.join(broadcast_ids(copies), "doc", "left_anti")
    return _repeated_paths(plain, originals, width, seed).withColumnRenamed("doc", key)


def _removed(words: Words, spans: pa.Array, copies: np.ndarray, width: int) -> np.ndarray:
    """Which words go."""
    sizes = np.diff(words.first)
    edge = np.zeros(len(words.starts) + 1, np.int64)
    counts = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    base = np.repeat(words.first[:-1], counts)
    np.add.at(edge, base + flat.field("start").to_numpy(), 1)
    np.add.at(edge, base + flat.field("stop").to_numpy(), -1)
    gone = np.cumsum(edge[:-1]) > 0
    gone[np.repeat(copies & (sizes >= width), sizes)] = True
    return gone


def cut(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, carry: tuple[str, ...] = (), texts: bool = True
) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 (kept words joined by one space), ``kept`` if ``texts``, and
    the columns to ``carry``.

    ``kept`` is the text without the bytes of removed words and of the white space that follows them; a text from which
    nothing is removed stays as it is, null too.
    """
    rest = [F.struct(*(docs[c] for c in carry)).alias("rest")] if carry else []
    both = docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("body"), *rest)
    plain = both.filter("doc IS NOT NULL")
    copies = settle(_exact_copies(plain), "copies")
    originals = plain.select("doc", "body").join(broadcast_ids(copies), "doc", "left_anti")
    spans = _repeated_paths(plain, originals, width, seed)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"), F.lit(False).alias("copy"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    changes = by_doc.unionByName(copies.select("doc", none.alias("spans"), F.lit(True).alias("copy")))
    changed = [F.coalesce("spans", none).alias("spans"), F.coalesce("copy", F.lit(False)).alias("copy")]
    joined = plain.join(changes, "doc", "left").select(*plain.columns, *changed)
    joined = joined.unionByName(both.filter("doc IS NULL").select("*", none.alias("spans"), F.lit(False).alias("copy")))
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept", T.StringType())] if texts else []), *([both.schema["rest"]] if carry else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit=HASHED_BYTES):
                words = split_words(part.column("body"))
                gone = _removed(words, part.column("spans"), part.column("copy").to_numpy(zero_copy_only=False), width)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                data = memoryview(words.data.tobytes())
                digests, kept = [], []
                whole = part.column("body").to_pylist() if texts else None
                for d in range(part.num_rows):
                    a, b = words.first[d], words.first[d + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a if removed[d] else np.arange(a, b)
                    words_left = [data[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]
                    digests.append(hashlib.sha256(b" ".join(words_left)).hexdigest())
                    if texts:
                        kept.append(_without(data, words, gone, a, b) if removed[d] else whole[d])
                columns = [part.column("doc"), pa.array(np.diff(words.first)), pa.array(removed), pa.array(digests)]
                columns += ([pa.array(kept, pa.string())] if texts else []) + ([part.column("rest")] if carry else [])
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = map_texts(joined, run, schema)
    return out.select(F.col("doc").alias(key), *schema.names[1:5 if texts else 4], *(F.col(f"rest.{c}") for c in carry))


def _without(data: memoryview, words: Words, gone: np.ndarray, a: int, b: int) -> str:
    """The text of words a to b less the removed ones; the space between kept neighbours stays as it was."""
    out, flips = [], np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
    for run_start, run_stop in flips.reshape(-1, 2) + a:
        stop = words.starts[run_stop] if run_stop < b else words.ends[run_stop - 1]
        out.append(bytes(data[words.starts[run_start] : stop]))
    return b"".join(out).decode().rstrip()
