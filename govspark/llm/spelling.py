"""Groups of spelling variants: words of a corpus that differ by one edit, found through Bloom filters of the vocabulary.

1. *Vocabulary.* Runs of letters are counted in every task and added up by word; a batch's distinct words travel, not its
   occurrences.
2. *Filters.* Words of one length are dealt to shards of about ``SHARD_WORDS``; each shard becomes a blocked Bloom filter of
   ``BITS`` bits a word: a word sets one bit in each of the 8 numbers of one block of 64 bytes.
3. *Neighbourhoods.* Every word's deletions and replacements by a larger symbol are hashed without being written down and
   probed against the filters of their length: so each unordered pair is met once. Filters travel to the tasks up to
   ``PASS_BYTES`` at a time; a larger vocabulary takes more passes, each over the words of the lengths it needs.
4. *Exact join.* Only edits that pass a filter are written down and meet the vocabulary by a join, which takes out what the
   filter let through by chance.
5. *Forms.* A word's form is its most frequent near word if that is at least ``factor`` times as frequent; roots follow the
   forms by doubling, in rounds that grow with the logarithm of the longest chain.

Defined results: a null text has no words; a null key counts as an empty one; a word of any length is probed whole; rows of
one key count as often as they come. Symbols are code points, and the edits use all symbols of the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.words import LOWER, mix, parts, text_buffers
from govspark.scratch import settle

BITS = 24
SHARD_WORDS = 1 << 16
#: Bytes of filters that travel to the tasks at once, and edits that are hashed at once.
PASS_BYTES = 64 << 20
EDITS = 1 << 20
#: Distinct words that a task holds before it gives them out.
HELD_WORDS = 400_000
#: Bytes of a word up to which its checksum is taken together with those of other words.
SHORT = 48

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


@dataclass
class Runs:
    """``data[starts[i]:ends[i]]`` is a run of letters A-Z a-z and U+00C0 to U+00FF, A-Z lowered, of text ``owner[i]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    lengths: np.ndarray


def letter_runs(texts: pa.Array) -> Runs:
    data, offsets = text_buffers(texts)
    data = LOWER[data]
    inside = (data >= 0x61) & (data <= 0x7A)
    lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF are the code points that this byte begins
    inside[lead] = True
    inside[lead + 1] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], finishes[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    further = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return Runs(data, starts, ends, owner, ends - starts - (further[ends] - further[starts]))


def checksums(prefixes: np.ndarray, runs: Runs) -> np.ndarray:
    """crc32 of the prefix of each run's text (given as its own crc32) and the run."""
    state, size = prefixes[runs.owner], runs.ends - runs.starts
    order = np.argsort(size, kind="stable")
    order = order[: np.searchsorted(size[order], SHORT, side="right")]
    going, sizes, at = ~state[order], size[order], runs.starts[order]
    out = np.empty(len(size), np.uint32)
    begin = 0
    for i in range(SHORT + 1):
        stop = int(np.searchsorted(sizes, i, side="right"))
        out[order[begin:stop]] = ~going[begin:stop]
        begin = stop
        live = going[begin:]
        going[begin:] = _CRC[(live ^ runs.data[at[begin:] + i if len(live) else at[:0]]) & 0xFF] ^ (live >> np.uint32(8))
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(runs.data[runs.starts[i] : runs.ends[i]].tobytes(), int(state[i]))
    return out


def _words_of(batch: pa.RecordBatch, least: int, slip: int | None) -> pa.Table:
    """(word, n) of a part: distinct words of at least ``least`` code points."""
    runs = letter_runs(batch.column("body"))
    long = runs.lengths >= least
    runs = Runs(runs.data, runs.starts[long], runs.ends[long], runs.owner[long], runs.lengths[long])
    changed: list[bytes] = []
    if slip:
        keys = batch.column("key").cast(pa.large_string()).fill_null("").to_pylist()
        h = checksums(np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32), runs)
        hit = h % slip == 0
        for i in np.flatnonzero(hit):
            word = runs.data[runs.starts[i] : runs.ends[i]].tobytes().decode()
            at = int(h[i]) % len(word)
            if len(word) > least:
                changed.append((word[:at] + word[at + 1 :]).encode())
        runs = Runs(runs.data, runs.starts[~hit], runs.ends[~hit], runs.owner[~hit], runs.lengths[~hit])
    size = runs.ends - runs.starts
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = runs.data[np.arange(bounds[-1]) + np.repeat(runs.starts - bounds[:-1], size)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    encoded = pa.concat_arrays([words, pa.array(changed, pa.large_binary())]).dictionary_encode()
    counts = np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary))
    return pa.table({"word": encoded.dictionary.cast(pa.large_string()), "n": pa.array(counts, pa.int64())})


def _summed(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lowered, of at least that length and number.

    With ``slip`` one code point is left out of each run whose checksum with its key is a multiple of it: planted misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in parts(batch):
                held.append(_words_of(part, least_length, slip))
                if sum(map(len, held)) > HELD_WORDS:
                    held = [_summed(held)]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from _summed(held).to_batches()

    plain = docs.select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("body"))
    counted = plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _symbol(codes: np.ndarray) -> np.ndarray:
    return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the words of it, their code points as a matrix)."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(words.take(pa.array(at)).to_pylist()).encode("utf-32-le"), np.uint32)
        yield int(length), at, codes.reshape(len(at), int(length))


def _sums(codes: np.ndarray) -> np.ndarray:
    """A polynomial of each word's symbols."""
    return (_symbol(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _bits(mixed: np.ndarray, i: int) -> np.ndarray:
    return (mixed >> np.uint64(6 * i)) & np.uint64(63)


class Filters:
    """Filters of some shards of each length: ``held`` maps a length to (first shard, shards in all, blocks a shard, words)."""

    def __init__(self, held: dict[int, tuple[int, int, int, np.ndarray]]):
        self.held = held

    def passing(self, length: int, sums: np.ndarray) -> np.ndarray:
        """Which of the words of that length, given by their polynomials, may be there."""
        if length not in self.held:
            return np.empty(0, np.int64)
        first, of, blocks, words = self.held[length]
        mixed = mix(sums)
        shard = _shard(mixed, of) - first
        at = np.arange(len(sums)) if len(words) == of * blocks * 8 else np.flatnonzero((shard >= 0) & (shard < len(words) // (8 * blocks)))
        mixed = mixed[at]
        block = (shard[at] * blocks + _block(mixed, blocks)) * 8
        mixed = mix(mixed ^ np.uint64(0x5851F42D4C957F2D))
        for i in range(8):
            there = (words[block + i] >> _bits(mixed, i)) & np.uint64(1) == 1
            at, block, mixed = at[there], block[there], mixed[there]
        return at


def _shard(mixed: np.ndarray, of: int) -> np.ndarray:
    return ((mixed & np.uint64(0xFFFFFF)) % np.uint64(of)).astype(np.int64)


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return (((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def blocks_of(words: int, shards: int) -> int:
    """Blocks of a shard's filter, for a length with that many words."""
    return max(1, -(-words * BITS // (512 * shards)))


def _build_filters(words: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(length, shard, words): one filter per shard; ``sizes`` maps a length to its (shards, blocks of each)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, codes in by_length(batch.column("word")):
                sums = _sums(codes)
                shard = _shard(mix(sums), sizes[length][0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), length), pa.int32()), pa.array(shard.astype(np.int32)), pa.array(sums.view(np.int64))], names=["length", "shard", "sum"])

    def run(group: pa.Table) -> pa.Table:
        blocks = sizes[group.column("length")[0].as_py()][1]
        words = np.zeros(blocks * 8, np.uint64)
        mixed = mix(group.column("sum").to_numpy().view(np.uint64))
        block = _block(mixed, blocks) * 8
        mixed = mix(mixed ^ np.uint64(0x5851F42D4C957F2D))
        for i in range(8):
            np.bitwise_or.at(words, block + i, np.uint64(1) << _bits(mixed, i))
        return pa.table({"length": group.column("length")[:1], "shard": group.column("shard")[:1], "words": pa.array([words.tobytes()], pa.binary())})

    return words.select("word").mapInArrow(hashed, "length int, shard int, sum long").groupBy("length", "shard").applyInArrow(run, "length int, shard int, words binary")


def _passes(sizes: dict[int, tuple[int, int]], limit: int) -> list[list[tuple[int, int, int]]]:
    """Runs (length, from shard, to shard) put together up to the limit of bytes."""
    out, held, used = [], [], 0
    for length in sorted(sizes):
        shards, blocks = sizes[length]
        begin = 0
        while begin < shards:
            room = max(1 if not held else 0, (limit - used) // (blocks * 64))
            end = min(shards, begin + room)
            if end > begin:
                held.append((length, begin, end))
                used += (end - begin) * blocks * 64
            if end < shards:
                out.append(held)
                held, used = [], 0
            begin = end
    return [*out, held] if held else out


def _load(stored: DataFrame, runs: list[tuple[int, int, int]], sizes: dict[int, tuple[int, int]]) -> Filters:
    """The filters of one pass: at most PASS_BYTES, or one shard."""
    held = {}
    wanted = F.lit(False)
    for length, begin, end in runs:
        shards, blocks = sizes[length]
        held[length] = (begin, shards, blocks, np.zeros((end - begin) * blocks * 8, np.uint64))
        wanted = wanted | ((F.col("length") == length) & F.col("shard").between(begin, end - 1))
    for row in stored.filter(wanted).collect():
        begin, _, blocks, words = held[row.length]
        words[(row.shard - begin) * blocks * 8 : (row.shard - begin + 1) * blocks * 8] = np.frombuffer(row.words, np.uint64)
    return Filters(held)


def _deletions(codes: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, shorter words as code points) of the deletions that pass; of a run of one symbol only its first is deleted."""
    length = codes.shape[1]
    if length < 2:
        return
    terms = _symbol(codes) * _powers(length)
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    sums = upto - terms + (upto[:, -1:] - upto) * back
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    places = np.flatnonzero(new.ravel())
    row, at = np.divmod(places[filters.passing(length - 1, sums.ravel()[places])], length)
    yield row, codes[row][np.arange(length) != at[:, None]].reshape(len(row), length - 1)


def _replacements(codes: np.ndarray, symbols: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, words with one symbol replaced by a larger one) of the replacements that pass."""
    rows, length = codes.shape
    terms, powers, new = _symbol(codes), _powers(length), _symbol(symbols)
    total = (terms * powers).sum(axis=1, dtype=np.uint64)
    step = max(1, EDITS // (rows * len(symbols)))
    for begin in range(0, length, step):
        some = slice(begin, begin + step)
        larger = symbols > codes[:, some, None]
        sums = (total[:, None, None] + (new - terms[:, some, None]) * powers[some][:, None])[larger]
        places = np.flatnonzero(larger.ravel())[filters.passing(length, sums)]
        row, at, symbol = np.unravel_index(places, larger.shape)
        out = codes[row]
        out[np.arange(len(row)), begin + at] = symbols[symbol]
        yield row, out


def _probe(words: DataFrame, symbols: np.ndarray, filters: Filters) -> DataFrame:
    """(word, n, other): edits of each word that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, places, codes in by_length(batch.column("word")):
                step = max(1, EDITS // max(length, len(symbols)))
                for begin in range(0, len(places), step):
                    some = codes[begin : begin + step]
                    found = list(_deletions(some, filters)) if length - 1 in filters.held else []
                    if length in filters.held:
                        found += _replacements(some, symbols, filters)
                    for row, edited in found:
                        if len(row):
                            joined, width = edited.astype("<u4").tobytes().decode("utf-32-le"), edited.shape[1]
                            others = [joined[i : i + width] for i in range(0, len(joined), width)]
                            of = batch.take(pa.array(places[begin + row]))
                            yield pa.RecordBatch.from_arrays([of.column("word"), of.column("n"), pa.array(others, pa.string())], names=["word", "n", "other"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(words: DataFrame, pass_bytes: int = PASS_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, other, other_n): unordered pairs of words that differ by one inserted, deleted or replaced code point.

    ``words`` is a stored table (word, n) of distinct words.
    """
    spark = words.sparkSession
    count = {r.length: r.m for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("m")).collect()}
    symbols = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("s")).filter("s <> ''").distinct().collect()
    symbols = np.array(sorted(ord(r.s) for r in symbols), np.uint32)
    shards = {length: -(-m // shard_words) for length, m in count.items()}
    sizes = {length: (shards[length], blocks_of(m, shards[length])) for length, m in count.items()}
    stored = settle(_build_filters(words, sizes), "spelling-filters")
    passing = spark.createDataFrame([], "word string, n long, other string")
    for runs in _passes(sizes, pass_bytes):
        lengths = sorted({x for length, _, _ in runs for x in (length, length + 1)} & set(count))
        probed = words.filter(F.char_length("word").isin(lengths)) if len(lengths) < len(count) else words
        passing = passing.unionByName(settle(_probe(probed, symbols, _load(stored, runs, sizes)), "spelling-passing"))
    return passing.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: forms followed to the last, twice as far in every round."""
    known = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = settle(known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not known.filter("moved").limit(1).count():
            return known.select("word", "root")
        known = known.select("word", "root")


def groups(words: DataFrame, factor: int = 2, **how) -> DataFrame:
    """Per word of the table (word, n): word, form, root, n, n_near, form_n."""
    words = settle(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, **how)
    sides = [F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(c).alias("m")) for a, b, c in (("word", "other", "other_n"), ("other", "word", "n"))]
    both = pairs.select(F.explode(F.array(*sides)).alias("e")).select("e.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("top"))
    joined = words.join(near, "word", "left").withColumn("is_form", -F.col("top.less") >= factor * F.col("n"))
    found = settle(
        joined.select(
            "word", F.when(F.col("is_form"), F.col("top.other")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), -F.col("top.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    out = found.join(_roots(found.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
