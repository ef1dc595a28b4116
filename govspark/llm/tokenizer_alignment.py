"""Alignment of two tokenizers over a corpus: which ids of one meet which ids of the other, and how often.

Both tokenizers read a blank and the text. Where both end a token they cut the text into groups; a token of A and one of B
whose bytes overlap are a link. Neither joins characters before a blank with the blank, so a text falls into chunks that are
aligned on their own; equal chunks are aligned once in a batch and kept. Tokenizers of another build get whole texts.

1. *First pass.* Every task counts the links of its texts by id pair; its sums are stored.
2. *Perfect hash.* The distinct pairs are dealt to shards, and each shard becomes a minimal perfect hash (``perfect_hash``).
   Shards are taken together up to ``PASS_PAIRS`` pairs, about 17 bytes each, which is what ever travels to a task; more pairs
   take more passes.
3. *Counts.* A task adds its sums into a dense vector by slot. Vectors are cut into slices, and slices are added up in a
   tree of ``FAN_IN`` at a time, so that no group holds more than that.
4. *Second pass.* Texts are aligned again; each link looks up its count and whether it is the highest of its B id. Sums over
   links add up over passes.

Defined results: a text that is null or empty, or whose tokens' bytes differ from blank and text, has no tokens: zeros and
an empty string. Rows come out as often as they go in, keys of any type and null ones too. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.perfect_hash import PerfectHash, Shard, build, shard_number
from govspark.llm.words import parts, text_buffers
from govspark.scratch import settle

#: Pairs of one shard, pairs whose hash and counts travel to a task at once, slots of a slice, slices added at once.
SHARD_PAIRS = 1 << 15
PASS_PAIRS = 4_000_000
SLICE = 1 << 16
FAN_IN = 32
#: Chunks and bytes that a worker keeps, and distinct pairs it holds before it gives them out.
CACHE_CHUNKS = 300_000
CACHE_BYTES = 64 << 20
HELD_PAIRS = 2_000_000
#: How byte-level vocabularies cut a text before they merge (fixed by that public format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_of_character() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes (fixed by that public format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A: a byte-level vocabulary file; B: a piece model with byte fallback, which puts a blank before the text itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_of_character()
        entries = {i: entry for entry, i in self.a.get_vocab(with_added_tokens=True).items()}
        a_bytes = [bytes(of.get(c, 0x3F) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        b_bytes = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_width, self.b_width = (np.array([len(x) for x in table], np.int64) for table in (a_bytes, b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        a_ends = [f"{i},".encode() for i in range(self.n_a)] + [f"{i}|".encode() for i in range(self.n_a)]
        self.written = pa.array(a_ends + [f"{i},".encode() for i in range(self.n_b)] + [f"{i};".encode() for i in range(self.n_b)], pa.large_binary())
        # chunks end before a blank that follows another character: no piece of either may go on over such a place
        self.chunked = self.a.normalizer is None and "ByteLevel" in repr(self.a.pre_tokenizer) and "add_prefix_space=False" in repr(self.a.pre_tokenizer)
        self.chunked &= "use_regex=False" not in repr(self.a.pre_tokenizer)
        self.chunked &= not any(b" " in piece.lstrip(b" ") for piece in b_bytes)
        self.ranked = self._ranked(a_path, entries, a_bytes)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ranked(self, a_path: str, entries: dict[int, str], a_bytes: list[bytes]):
        """The faster encoder of the same merges, if the file's merges are in the order of their ids."""
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [self.a.token_to_id(x + y) for x, y in merges]
        if not self.chunked or None in ids or ids != sorted(set(ids)) or len(set(a_bytes)) != len(a_bytes):
            return None
        special = {i for i, added in self.a.get_added_tokens_decoder().items() if added.special}
        ranks = {a_bytes[i]: i for i in entries if i not in special}
        if len(ranks) != len(ids) + 256:
            return None
        return tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids by A, their number for each chunk, ids by B, their number); chunks begin with the blank."""
        if self.ranked is not None:
            a = list(map(self.ranked.encode_ordinary, chunks))
        else:
            a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        b = [[self.blank] if c == " " else ids for c, ids in zip(chunks, b)]  # B has no blank before an empty text
        flat = [np.fromiter(chain.from_iterable(lists), np.int64) for lists in (a, b)]
        sizes = [np.fromiter(map(len, lists), np.int64, len(lists)) for lists in (a, b)]
        return flat[0], sizes[0], flat[1], sizes[1]


@cache
def load_tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Once in a worker process."""
    return Tokenizers(a_path, b_path)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _cut(texts: pa.Array, chunked: bool) -> tuple[pa.Array, np.ndarray]:
    """(chunks of blank and text of all texts, where each text begins in them)."""
    data, offsets = text_buffers(texts)
    lengths = np.diff(offsets)
    ends = offsets[1:] + np.arange(1, len(lengths) + 1)
    heads = ends - lengths - 1
    spaced = np.empty(len(data) + len(lengths), np.uint8)
    body = np.ones(len(spaced), bool)
    body[heads] = False
    spaced[body], spaced[heads] = data, 0x20
    starts = np.zeros(len(spaced), bool)
    if chunked and len(spaced) > 2:
        before, earlier = spaced[1:-1], spaced[:-2]
        # white space beyond ASCII ends in two bytes of which the first is one of these
        plain = np.where(before < 0x80, (before > 0x20) & (before < 0x7F), ~np.isin(earlier, (0xC2, 0x80, 0x81, 0x9A)))
        starts[2:] = (spaced[2:] == 0x20) & plain
    starts[heads] = True
    at = np.flatnonzero(starts)
    cuts = np.append(at, len(spaced))
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(spaced)])
    return chunks, np.append(np.searchsorted(at, heads), len(at))


class Aligned:
    """Alignments of distinct chunks: numbers of tokens, groups and links, id pairs of the links, the groups in writing."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.size = 0
        self.ok = np.empty(0, bool)
        self.counts = np.empty((0, 3), np.int64)
        self.links, self.pairs = np.zeros(1, np.int64), np.empty(0, np.int64)
        self.marks, self.text = np.zeros(1, np.int64), np.empty(0, np.uint8)

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """Where the chunks stand in the arrays; unknown ones are aligned first."""
        if len(self.place) > CACHE_CHUNKS or self.size > CACHE_BYTES:
            self._forget()
        missing = [c for c in chunks if c not in self.place]
        if missing:
            ok, counts, links, pairs, marks, text = self._align(missing)
            self.place.update(zip(missing, range(len(self.place), len(self.place) + len(missing))))
            self.ok, self.counts = np.append(self.ok, ok), np.concatenate([self.counts, counts])
            self.links, self.pairs = np.append(self.links, self.links[-1] + links[1:]), np.append(self.pairs, pairs)
            self.marks, self.text = np.append(self.marks, self.marks[-1] + marks[1:]), np.append(self.text, text)
            self.size += sum(map(len, missing)) + len(text) + pairs.nbytes
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def _align(self, chunks: list[bytes]) -> tuple[np.ndarray, ...]:
        known = self.tokenizers
        a, n_a, b, n_b = known.encode([c.decode() for c in chunks])
        ok, whole = np.ones(len(chunks), bool), b"".join(chunks)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for ids, sizes, table, width in ((a, n_a, known.a_bytes, known.a_width), (b, n_b, known.b_bytes, known.b_width)):
            ends = _bounds(width[ids])[_bounds(sizes)]
            ok &= np.diff(ends) == length
            joined = _buffers(table.take(pa.array(ids)))[0].tobytes()
            if joined != whole:
                ok &= np.fromiter((joined[i:j] == c for c, i, j in zip(chunks, ends, ends[1:])), bool, len(chunks))
        a, n_a = a[np.repeat(ok, n_a)], np.where(ok, n_a, 0)
        b, n_b = b[np.repeat(ok, n_b)], np.where(ok, n_b, 0)
        place = _bounds(np.where(ok, length, 0))
        ends_a, ends_b = np.cumsum(known.a_width[a]), np.cumsum(known.b_width[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, cuts)] * known.n_b + b[np.searchsorted(ends_b, cuts)]
        links, groups = (np.diff(np.searchsorted(x, place, side="right")) for x in (cuts, both))
        # tokens of A and then of B, group by group
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        order = np.empty(len(a) + len(b), np.int64)
        order[at_a] = a + known.n_a * np.isin(ends_a, both, assume_unique=True)
        order[at_b] = 2 * known.n_a + b + known.n_b * np.isin(ends_b, both, assume_unique=True)
        data, offsets = _buffers(known.written.take(pa.array(order)))
        return ok, np.stack([n_a, n_b, groups], 1), _bounds(links), pairs, offsets[_bounds(n_a + n_b)], data


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large binary array, one after another, and the bounds."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return text_buffers(values.view(pa.large_string()))


def _segments(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers first[i] to first[i] + sizes[i] - 1, one after another."""
    return np.arange(sizes.sum()) + np.repeat(first - _bounds(sizes)[:-1], sizes)


class _Part:
    """The texts of one part over a worker's alignments."""

    def __init__(self, aligned: Aligned, texts: pa.Array):
        chunks, self.first = _cut(texts, aligned.tokenizers.chunked)
        encoded = chunks.dictionary_encode()
        self.aligned = aligned
        self.distinct = aligned.numbers(encoded.dictionary.to_pylist())
        self.indices = encoded.indices.to_numpy()
        filled = np.array(texts.is_valid()) & (np.diff(text_buffers(texts)[1]) > 0)
        self.ok = filled & (self.total(~aligned.ok[self.distinct]) == 0)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Per text the sum of a value per distinct chunk."""
        return np.diff(_bounds(values[self.indices])[self.first])

    def pair_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pairs, number of links that hold each) over the texts that have tokens."""
        used = np.bincount(self.indices[np.repeat(self.ok, np.diff(self.first))], minlength=len(self.distinct))
        pairs, sizes = self.distinct_pairs()
        pairs, inverse = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, inverse, np.repeat(used, sizes))
        return pairs[sums > 0], sums[sums > 0]

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pairs of the links of all distinct chunks, number of each chunk's)."""
        links = self.aligned.links
        sizes = links[self.distinct + 1] - links[self.distinct]
        return self.aligned.pairs[_segments(links[self.distinct], sizes)], sizes

    def written(self) -> list[memoryview]:
        """Per text its groups in writing."""
        marks = self.aligned.marks
        order = self.distinct[self.indices]
        bounds = _bounds(marks[order + 1] - marks[order])[self.first]
        data = memoryview(self.aligned.text[_segments(marks[order], marks[order + 1] - marks[order])])
        return [data[i : j - 1] if ok else data[:0] for ok, i, j in zip(self.ok, bounds, bounds[1:])]


def _add_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, inverse = np.unique(np.concatenate([np.empty(0, np.int64), *(p for p, _ in held)]), return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, inverse, np.concatenate([np.empty(0, np.int64), *(s for _, s in held)]))
    return pairs, sums


def _task_sums(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(pair, h, k): the links that each task meets, added up in it; ``h`` deals pairs to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Aligned(load_tokenizers(*paths))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give() -> pa.RecordBatch:
            pairs, sums = held[0]
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(shard_number(pairs)), pa.array(sums)], names=["pair", "h", "k"])

        for batch in batches:
            for part in parts(batch):
                held.append(_Part(aligned, part.column("body")).pair_sums())
                if sum(len(p) for p, _ in held) > HELD_PAIRS:
                    held = [_add_up(held)]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield give()
                        held = []
        if held:
            held = [_add_up(held)]
            yield give()

    return texts.mapInArrow(run, "pair long, h long, k long")


def _hash_shards(sums: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its perfect hash. A shard holds about SHARD_PAIRS pairs."""

    def run(group: pa.Table) -> pa.Table:
        shard = build(group.column("pair").to_numpy())
        row = {"shard": [group.column("shard")[0].as_py()], "n": [len(shard.keys)], "sizes": [shard.sizes.tolist()]}
        return pa.table(row | {"words": pa.array([shard.words.tobytes()], pa.binary()), "keys": pa.array([shard.keys.tobytes()], pa.binary())})

    distinct = sums.select((F.col("h") % shards).alias("shard"), "pair").distinct()
    return distinct.groupBy("shard").applyInArrow(run, "shard long, n long, sizes array<long>, words binary, keys binary")


def _passes(sizes: dict[int, int], shards: int, limit: int) -> list[tuple[int, int]]:
    """Runs of shards, [from, to), of at most ``limit`` pairs each (a single shard is one run at least)."""
    out, begin, held = [], 0, 0
    for shard in range(shards):
        if held and held + sizes.get(shard, 0) > limit:
            out.append((begin, shard))
            begin, held = shard, 0
        held += sizes.get(shard, 0)
    return [*out, (begin, shards)]


def _load(stored: DataFrame, begin: int, end: int, shards: int) -> PerfectHash:
    """The hash of a run of shards: at most PASS_PAIRS pairs come to the driver, to be sent to the tasks."""
    rows = {r.shard: r for r in stored.filter(F.col("shard").between(begin, end - 1)).collect()}
    none = Shard(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    read = [Shard(np.array(r.sizes, np.int64), np.frombuffer(r.words, np.uint64), np.frombuffer(r.keys, np.int64)) if (r := rows.get(i)) else none for i in range(begin, end)]
    return PerfectHash(read, begin, shards)


def _tree_sum(vectors: DataFrame, name: str) -> DataFrame:
    """(slice, sums): slices of dense vectors added up, FAN_IN at a time."""

    def run(group: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(v.as_py(), np.int64) for v in group.column("sums")))
        return pa.table({"slice": group.column("slice")[:1], "node": group.column("node")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    while True:
        vectors = settle(vectors.withColumn("node", F.floor(F.col("node") / FAN_IN)), name)
        vectors = settle(vectors.groupBy("slice", "node").applyInArrow(run, "slice int, node long, sums binary"), name)
        if (vectors.agg(F.max("node")).first()[0] or 0) == 0:
            return vectors.select("slice", "sums")


def _dense_counts(sums: DataFrame, known: PerfectHash) -> DataFrame:
    """(slice, sums): the counts of all pairs of ``known``, a vector by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector = np.zeros(len(known), np.int64)
        for batch in batches:
            slots = known.slots(batch.column("pair").to_numpy())
            np.add.at(vector, slots[slots >= 0], batch.column("k").to_numpy()[slots >= 0])
        for i in range(0, len(vector), SLICE):
            piece = vector[i : i + SLICE]
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // SLICE], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([piece.tobytes()], pa.binary())],
                    names=["slice", "node", "sums"],
                )

    return _tree_sum(sums.select("pair", "k").mapInArrow(run, "slice int, node long, sums binary"), "alignment-counts")


def _pair_rows(slices: DataFrame, known: PerfectHash, n_b: int) -> DataFrame:
    """(a, b, n) of the slices of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sums in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
                counts = np.frombuffer(sums, np.int64)
                pairs = known.keys[number * SLICE : number * SLICE + len(counts)]
                yield pa.RecordBatch.from_arrays([pa.array((pairs // n_b).astype(np.int32)), pa.array((pairs % n_b).astype(np.int32)), pa.array(counts)], names=["a", "b", "n"])

    return slices.mapInArrow(run, "a int, b int, n long")


class Alignment:
    """Links of a corpus, counted by id pair: ``pairs`` is the table (a, b, n)."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", pass_pairs: int = PASS_PAIRS, shard_pairs: int = SHARD_PAIRS):
        self.paths, self.n_b = (a_path, b_path), load_tokenizers(a_path, b_path).n_b
        self.docs = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("body"))
        spark = docs.sparkSession
        sums = settle(_task_sums(self.docs.select("body"), self.paths), "alignment-sums")
        self.shards = max(1, -(-sums.select("pair").distinct().count() // shard_pairs))
        self.stored = settle(_hash_shards(sums, self.shards), "alignment-hash")
        sizes = {r.shard: r.n for r in self.stored.select("shard", "n").collect()}
        self.runs, self.slices = _passes(sizes, self.shards, pass_pairs), []
        self.pairs = spark.createDataFrame([], "a int, b int, n long")
        for begin, end in self.runs:
            known = _load(self.stored, begin, end, self.shards)
            mine = sums.filter((F.col("h") % self.shards).between(begin, end - 1))
            slices = _dense_counts(mine, known)
            self.slices.append(slices)
            self.pairs = self.pairs.unionByName(settle(_pair_rows(slices, known, self.n_b), "alignment-pairs"))

    def _highest(self) -> np.ndarray:
        """Per B id the highest count of a pair; as many rows as B has ids."""
        best = np.zeros(self.n_b, np.int64)
        for row in self.pairs.groupBy("b").agg(F.max("n").alias("n")).collect():
            best[row.b] = row.n
        return best

    def documents(self, groups: bool = False) -> DataFrame:
        """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and on request ``groups``."""
        best, docs, parts_of = self._highest(), self.docs, []
        if len(self.runs) > 1:  # rows need a lasting number to be put together again
            docs = settle(docs.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
        for (begin, end), slices in zip(self.runs, self.slices):
            known = _load(self.stored, begin, end, self.shards)
            counts = np.zeros(len(known), np.int64)
            for row in slices.collect():
                piece = np.frombuffer(row.sums, np.int64)
                counts[row.slice * SLICE : row.slice * SLICE + len(piece)] = piece
            highest = counts == best[known.keys % self.n_b]
            parts_of.append(self._look_up(docs, known, counts, highest, groups, first=not parts_of))
        out = parts_of[0]
        if len(parts_of) > 1:
            same = [F.first(c, ignorenulls=True).alias(c) for c in out.columns if c not in ("row", "n_best", "count_sum")]
            sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
            out = reduce(DataFrame.unionByName, parts_of).groupBy("row").agg(*same, *sums).select(*out.columns)
        return out.drop("row")

    def _look_up(self, docs: DataFrame, known: PerfectHash, counts: np.ndarray, highest: np.ndarray, groups: bool, first: bool) -> DataFrame:
        kept = [f for f in docs.schema.fields if f.name != "body"]
        numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        texts = ["groups_sha256", "groups"] if groups else ["groups_sha256"]
        schema = T.StructType(kept + [T.StructField(c, T.LongType()) for c in numbers] + [T.StructField(c, T.StringType()) for c in texts])
        paths = self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligned = Aligned(load_tokenizers(*paths))
            for batch in batches:
                for part in parts(batch):
                    here = _Part(aligned, part.column("body"))
                    pairs, sizes = here.distinct_pairs()
                    slots = known.slots(pairs)
                    held, cuts = slots >= 0, _bounds(sizes)
                    in_chunk = [np.diff(_bounds(np.where(held, v[slots] if len(v) else 0, 0))[cuts]) for v in (highest.astype(np.int64), counts)]
                    per_chunk = [*aligned.counts[here.distinct].T, sizes, *in_chunk]
                    columns = [pa.array(np.where(here.ok, here.total(v), 0)) for v in per_chunk]
                    written = here.written() if first else [None] * part.num_rows  # one pass writes the groups
                    columns.append(pa.array([(hashlib.sha256(w).hexdigest() if len(w) else "") if first else None for w in written], pa.string()))
                    if groups:
                        columns.append(pa.array([bytes(w).decode() if first else None for w in written], pa.string()))
                    yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + columns, names=schema.names)

        return docs.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", groups: bool = False, **how) -> DataFrame:
    """Per document of ``docs`` what its alignment holds, under the name of its key."""
    return Alignment(docs, a_path, b_path, key, text, **how).documents(groups).withColumnRenamed("key", key)
