"""A stored inverted index of posts, searched with tolerance for typing errors.

Two tables lie in the index's folder, both dealt to folders by a hash and sorted, so that a search reads the files of its own
words only:

- ``postings``: term and its places in a chunk of posts, as two rows of equally wide numbers: the posts' keys, each less the one
  before and the first less ``base``, and ``position * attributes + attribute``. A term that is common in a chunk is dealt to
  several files.
- ``variants``: what is left of a term's first ``PREFIX`` characters after up to as many deletions as a typing error may
  cost, with the terms between blanks. Two words within that distance share a variant, so candidates come by equality; the distance decides.

A post is found if every word of the query is near a word of it. The order is: typing errors (per word the least), proximity
(per pair of neighbouring query words the least distance of their best places in one attribute, at most ``FAR``), attribute
(per word the first that holds it best), key.

A search moves each place of a wanted term once, to the block of its post. There posts meet the queries of one pass after the
other, and only the best ``k`` of every query leave a block, however many posts hold its words. First terms with one typing
error at most are tried: a query that finds ``k`` posts with one in all needs no others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.scratch import settle

# Lengths from which a query word may have one or two typing errors.
ONE_TYPO, TWO_TYPOS = 4, 8
PREFIX, FAR = 7, 8
#: Rows of one folder of a table, and terms or variants that may become a filter of the scan.
FOLDER_ROWS, FILTER_TERMS = 2_000_000, 1000
MAX_FOLDERS = 4096
#: Characters of a word and the blank after it, by which the rows of ``postings`` are told.
WORD_CHARS = 6
#: Rows of a small table that travel to every task at once; more travel one after another.
TRAVEL_ROWS = 500_000
#: Rows of terms near the words of those queries that are searched in one pass.
NEAR_ROWS = 1_000_000
#: Rows of one block of posts, rows that are met at once, and rows that one task gets.
BLOCK_ROWS, MEET_ROWS, TASK_ROWS = 200_000, 500_000, 4_000_000
#: Places, or terms, that are grouped at once while the index is built.
CHUNK_ROWS, CHUNK_TERMS = 1_500_000, 40_000
#: A term with such a share of a chunk's places is dealt to so many parts of its folder.
HOT_SHARE, HOT_PARTS = 0.001, 8
#: A place of a wanted term on its way to the block of its post.
PLACE = np.dtype([("key", np.int64), ("id", np.uint32), ("place", np.uint32)])
NO_KEY = -(2**63)
#: Bytes of a batch that is handed to a Python worker.
BATCH_BYTES, PART_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def _small_batches(spark: SparkSession) -> None:
    """Batches of about PART_BYTES, unless the session has a bound of its own: by rows alone they may be of any size."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(PART_BYTES))


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def allowed_typos(word: Column) -> Column:
    return F.when(F.length(word) >= TWO_TYPOS, 2).when(F.length(word) >= ONE_TYPO, 1).otherwise(0)


def _term_typos(term: Column) -> Column:
    """The most typing errors of any query word that this term may answer: such a word is longer by as many at most."""
    return F.when(F.length(term) >= TWO_TYPOS - 2, 2).when(F.length(term) >= ONE_TYPO - 1, 1).otherwise(0)


def _variants(word: Column, typos: Column) -> Column:
    """What is left of the first characters after up to that many deletions."""
    start = F.substr(word, F.lit(1), F.lit(PREFIX))

    def without(*places: int) -> Column:
        ends = [0, *places, PREFIX + 1]
        left = F.concat(*(F.substr(start, F.lit(a + 1), F.lit(b - a - 1)) for a, b in zip(ends, ends[1:])))
        return F.when((F.length(start) >= places[-1]) & (typos >= len(places)), left)

    once = [without(i) for i in range(1, PREFIX + 1)]
    twice = [without(i, j) for i in range(1, PREFIX) for j in range(i + 1, PREFIX + 1)]
    return F.array_distinct(F.array_compact(F.array(start, *once, *twice)))


def _folders(rows: int) -> int:
    return max(1, min(MAX_FOLDERS, -(-rows // FOLDER_ROWS)))


def _folder(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def _write(df: DataFrame, path: str, by: str, part: Column, n: int) -> None:
    """Rows in folders by hash of ``by``, sorted by it; a folder's rows are spread over files by ``part``."""
    placed = df.withColumn("folder", _folder(F.col(by), n)).repartition("folder", part).drop("salt")
    placed.sortWithinPartitions("folder", by).write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(path)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as the largest needs."""
    return values.astype(next(k for k in ("u1", "u2", "u4", "u8") if int(values.max(initial=0)) < 2 ** (8 * int(k[1]))))


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive values as one binary for each end; the first begins at 0."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))]).cast(pa.binary())


def _values(blobs: pa.Array, kind: np.dtype | str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of the binaries, how many each has)."""
    blobs = pa.concat_arrays([blobs]).cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    kind = np.dtype(kind)
    if not len(blobs) or offsets[0] == offsets[-1]:
        return np.empty(0, kind), np.diff(offsets) // kind.itemsize
    return np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // kind.itemsize


POSTINGS = "term string, base long, wide short, posts binary, places binary, salt short"


def _grouped(key: pa.Array, texts: pa.Array, attributes: int) -> pa.RecordBatch:
    """The places in some posts (key, words of each attribute), by term.

    ``wide`` is the bytes of a number of ``posts`` times 16, plus those of ``places``; ``salt`` is not 0 for common terms.
    """
    each = texts.flatten()
    count = np.diff(np.asarray(each.offsets))
    terms = each.flatten().dictionary_encode()
    codes = terms.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    row = np.repeat(np.arange(len(count)), count)[order]
    position = (np.arange(len(codes)) - np.repeat(np.cumsum(count) - count, count))[order]
    keys = key.to_numpy().astype(np.int64)
    base = int(keys.min(initial=0)) if len(keys) and keys.min() < 0 else int(keys.min(initial=np.iinfo(np.int64).max))
    away = keys.view(np.uint64) - np.int64(base).view(np.uint64)  # right for any two keys
    posts = _narrow(away)[row // attributes]
    places = _narrow(position * attributes + row % attributes)
    n = np.bincount(codes, minlength=len(terms.dictionary))
    ends, hot = np.cumsum(n), n >= max(2, HOT_SHARE * len(codes))
    steps = posts.copy()
    steps[1:] -= posts[:-1]  # modulo the width
    steps[(ends - n)[n > 0]] = posts[(ends - n)[n > 0]]
    wide = np.full(len(n), steps.itemsize * 16 + places.itemsize, np.int16)
    salt = np.where(hot, 1 + zlib.crc32(keys.tobytes()) % HOT_PARTS, 0).astype(np.int16)
    columns = [terms.dictionary, pa.array(np.full(len(n), base)), pa.array(wide), _blobs(steps, ends), _blobs(places, ends), pa.array(salt)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "base", "wide", "posts", "places", "salt"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, texts, n) in chunks of about CHUNK_ROWS words, ``n`` in each row."""
    held, rows = [], 0
    for batch in batches:
        total, at = np.cumsum(batch.column(2).to_numpy()), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK_ROWS - rows, side="right")))
            held.append(batch.slice(at, stop - at))
            rows += int(total[stop - 1] - (total[at - 1] if at else 0))
            at = stop
            if rows >= CHUNK_ROWS or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _term_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, terms) of terms (term, typos), as ``_variants`` has them, grouped within some terms."""
    deletions = [(i,) for i in range(1, PREFIX + 1)] + [(i, j) for i in range(1, PREFIX) for j in range(i + 1, PREFIX + 1)]
    for term, typos in _term_chunks(batches):
        typos, start = typos.to_numpy(), pc.utf8_slice_codeunits(term, 0, PREFIX)
        length = pc.utf8_length(start).to_numpy()
        owners, found = [np.arange(len(term))], [start]
        for places in deletions:
            some = np.flatnonzero((length >= places[-1]) & (typos >= len(places)))
            mine, ends = start.take(pa.array(some)), [0, *places, PREFIX + 1]
            parts = [pc.utf8_slice_codeunits(mine, a, b - 1) for a, b in zip(ends, ends[1:]) if b - 1 > a]
            owners.append(some)
            found.append(pc.binary_join_element_wise(*parts, ""))
        variants = pa.concat_arrays(found).dictionary_encode()
        pairs = np.unique(variants.indices.to_numpy().astype(np.int64) * len(term) + np.concatenate(owners))
        first = np.searchsorted(pairs, np.arange(len(variants.dictionary) + 1) * len(term))
        terms = pa.ListArray.from_arrays(pa.array(first, pa.int32()), term.take(pa.array(pairs % len(term))))
        yield pa.RecordBatch.from_arrays([variants.dictionary, pc.binary_join(terms, " ")], names=["variant", "terms"])


def _term_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of CHUNK_TERMS rows or more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_TERMS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns


def build(posts: DataFrame, path: str, key: str, attributes: list[str]) -> None:
    """Writes the index of the texts in ``attributes``, the most important first; ``key`` is a unique number."""
    spark = posts.sparkSession
    _small_batches(spark)
    texts = F.array(*(words(F.col(a)) for a in attributes))
    number = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    cut = posts.select(number.alias("key"), texts.alias("texts"))
    cut = cut.withColumn("n", F.aggregate("texts", F.lit(0).cast("long"), lambda n, w: n + F.size(w)))
    many = len(attributes)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield _grouped(chunk.column(0), chunk.column(1), many)

    chars = sum((F.coalesce(F.sum(F.length(a)), F.lit(0)) for a in attributes), F.lit(0))
    rows = int(posts.agg(chars).first()[0] // WORD_CHARS)
    sizes = {"postings": _folders(rows), "rows": rows, "attributes": many, "key": posts.schema[key].dataType.simpleString()}
    files = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // sizes["postings"]))
    part = F.when(F.col("salt") > 0, -F.col("salt").cast("int")).otherwise(F.pmod(F.hash("term"), F.lit(files)))
    _write(cut.mapInArrow(group, POSTINGS), f"{path}/postings", "term", part, sizes["postings"])
    # neighbours share most variants
    terms = settle(spark.read.parquet(f"{path}/postings").select("term").distinct().orderBy("term"), "terms")
    typos, start = _term_typos(F.col("term")), F.least(F.length("term"), F.lit(PREFIX))
    most = 1 + F.when(typos >= 1, start).otherwise(0) + F.when(typos >= 2, F.floor(start * (start - 1) / 2)).otherwise(0)
    sizes["variants"] = _folders(terms.agg(F.sum(most)).first()[0] or 0)
    files = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // sizes["variants"]))
    left = terms.select("term", typos.cast("int").alias("typos")).mapInArrow(_term_variants, "variant string, terms string")
    _write(left, f"{path}/variants", "variant", F.pmod(F.hash("variant"), F.lit(files)), sizes["variants"])
    spark.createDataFrame([(json.dumps(sizes),)], "sizes string").coalesce(1).write.mode("overwrite").text(f"{path}/sizes")


def _sizes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/sizes").first()["value"])


def _read(spark: SparkSession, path: str, name: str, by: str, wanted: DataFrame) -> DataFrame:
    """The rows of a table whose ``by`` is wanted: few values become a filter of folders and files, many a join."""
    n = _sizes(spark, path)[name]
    stored = spark.read.parquet(f"{path}/{name}")
    values = [r[0] for r in wanted.select(by).distinct().limit(FILTER_TERMS + 1).collect()]
    if len(values) <= FILTER_TERMS:
        folders = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(_folder(F.col("v"), n)).distinct().collect()]
        stored = stored.where(F.col("folder").isin(folders) & F.col(by).isin(values))
    return stored.drop("folder")


def _met(stored: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """A join that leaves the stored rows where they are: what is wanted travels to them, in parts if there is much."""
    parts = max(1, -(-wanted.count() // TRAVEL_ROWS))
    met = [stored.join(F.broadcast(wanted.where(_folder(F.col(by), parts) == i)), by) for i in range(parts)]
    for more in met[1:]:
        met[0] = met[0].unionByName(more)
    return met[0]


def candidates(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(word, term, typos): terms of the index near each ``word``."""
    tried = asked.select("word").distinct().withColumn("allowed", allowed_typos(F.col("word")))
    tried = settle(tried.withColumn("variant", F.explode(_variants(F.col("word"), F.col("allowed")))), "tried")
    met = _met(_read(spark, path, "variants", "variant", tried), tried, "variant")
    met = met.select("word", "allowed", F.explode(F.split("terms", " ")).alias("term")).distinct()
    distance = F.levenshtein("word", "term")
    return met.withColumn("typos", distance).where(F.col("typos") <= F.col("allowed")).select("word", "term", "typos")


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., ``count[0]`` of them, then those of first[1], and so on."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(first - before, count)


def _pieces(count: np.ndarray) -> Iterator[slice]:
    """Slices whose counts add up to MEET_ROWS or, where one alone has more, to that one's."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEET_ROWS, side="right")))
        yield slice(at, stop)
        at = stop


@dataclass
class Asked:
    """Queries of one pass. Term ``ids[i]`` answers the words ``word[first[i]:first[i + 1]]`` with so many ``typos``; query q
    is the words ``of[begin[q]:begin[q + 1]]``."""

    ids: np.ndarray
    first: np.ndarray
    word: np.ndarray
    typos: np.ndarray
    begin: np.ndarray
    of: np.ndarray
    words: int


@dataclass
class Best:
    """The best ``k`` posts so far of every query, in order: (query, typos, proximity, attribute, key)."""

    queries: int
    k: int
    rows: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.rows = np.empty((5, 0), np.int64)
        self.last = np.full((4, self.queries), np.iinfo(np.int64).max)

    def may_enter(self, query: np.ndarray, *rank: np.ndarray) -> np.ndarray:
        enters = np.zeros(len(query), bool)
        for mine, last in zip(rank[::-1], self.last[::-1]):
            enters = (mine < last[query]) | ((mine == last[query]) & enters)
        return enters

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows], axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.k]
        full = rows[:, place == self.k - 1]
        self.last[:, full[0]] = full[1:]


class Block:
    """Places of terms that are asked for in some posts, whole ones, by post."""

    def __init__(self, asked: Asked, key: np.ndarray, term: np.ndarray, attribute: np.ndarray, position: np.ndarray) -> None:
        self.asked = asked
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.key, post = key[new], np.cumsum(new) - 1
        at = np.searchsorted(asked.ids, term)
        count = asked.first[at + 1] - asked.first[at]
        entry, row = _ranges(asked.first[at], count), np.repeat(np.arange(len(key)), count)
        code, typos = post[row] * asked.words + asked.word[entry], asked.typos[entry]
        order = np.lexsort((position[row], attribute[row], typos, code))
        code, typos, row = code[order], typos[order], row[order]
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        #: words in posts: which, with how many typing errors at least, and the first attribute that has it so
        self.code, self.typos, self.attribute = code[begins], typos[begins], attribute[row[begins]]
        pair = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(code))))
        best = typos == self.typos[pair]
        self.span, self.attributes = int(position.max()) + 1, int(attribute.max()) + 1
        #: the best places of each word in a post, in order
        self.places = (pair[best] * self.attributes + attribute[row[best]]) * self.span + position[row[best]]
        self.first_place = np.searchsorted(self.places, np.arange(len(begins) + 1) * self.attributes * self.span)

    def nearest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least distance, 1 to FAR, of places of two words of a post in one attribute."""
        sizes = np.diff(self.first_place)
        left, right = np.where(sizes[left] <= sizes[right], (left, right), (right, left))
        out = np.full(len(left), FAR)
        width = self.attributes * self.span
        for some in _pieces(sizes[left]):
            count = sizes[left[some]]
            there = self.places[_ranges(self.first_place[left[some]], count)] + np.repeat((right[some] - left[some]) * width, count)
            after = np.searchsorted(self.places, there)
            near = np.full(len(there), FAR)
            for at in (np.minimum(after, len(self.places) - 1), np.maximum(after - 1, 0)):
                same = self.places[at] // self.span == there // self.span
                near = np.where(same, np.minimum(near, np.abs(self.places[at] - there)), near)
            out[some] = np.minimum.reduceat(near, np.cumsum(count) - count)
        return np.maximum(out, 1)

    def meet(self, best: Best) -> None:
        """Every query meets the posts that hold the rarest of its words here."""
        asked = self.asked
        by_word = np.argsort(self.code % asked.words, kind="stable")
        held = np.bincount(self.code % asked.words, minlength=asked.words)
        first = np.cumsum(held) - held
        least = np.minimum.reduceat(held[asked.of], asked.begin[:-1])
        n = np.diff(asked.begin)
        rarest = np.flatnonzero(held[asked.of] == np.repeat(least, n))
        owner = np.repeat(np.arange(len(n)), n)[rarest]
        rarest = rarest[np.concatenate([[True], owner[1:] != owner[:-1]])]
        live = np.flatnonzero(least)
        for some in _pieces(least[live]):
            queries = live[some]
            query = np.repeat(queries, least[queries])
            post = self.code[by_word[_ranges(first[asked.of[rarest[queries]]], least[queries])]] // asked.words
            self._rank(query, post, n, best)

    def _rank(self, query: np.ndarray, post: np.ndarray, n: np.ndarray, best: Best) -> None:
        asked, most = self.asked, int(n[query].max())
        pairs = np.full((most, len(query)), -1)
        stays = np.ones(len(query), bool)
        for i in range(most):
            has = np.flatnonzero(n[query] > i)
            wanted = post[has] * asked.words + asked.of[asked.begin[query[has]] + i]
            at = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
            pairs[i, has] = at
            stays[has] &= self.code[at] == wanted
        query, post, pairs = query[stays], post[stays], pairs[:, stays]
        typos = np.where(pairs >= 0, self.typos[pairs], 0).sum(axis=0)
        attribute = np.where(pairs >= 0, self.attribute[pairs], 0).sum(axis=0)
        stays = best.may_enter(query, typos, n[query] - 1, attribute, self.key[post])
        query, post, pairs, typos, attribute = query[stays], post[stays], pairs[:, stays], typos[stays], attribute[stays]
        proximity = np.zeros(len(query), np.int64)
        for left, right in zip(pairs[:-1], pairs[1:]):
            both = np.flatnonzero(right >= 0)
            each, back = np.unique(left[both] * len(self.code) + right[both], return_inverse=True)
            proximity[both] += self.nearest(each // len(self.code), each % len(self.code))[back]
        best.add(np.stack([query, typos, proximity, attribute, self.key[post]]))


def _dealt(met: DataFrame, blocks: int) -> DataFrame:
    """(block, among, rows): places of wanted terms (id, base, wide, posts, places) by block of posts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids, base, wide, posts, places = batch.columns
            wide = wide.to_numpy()
            count = pc.binary_length(places).to_numpy() // (wide % 16)
            for both in np.unique(wide):
                some = np.flatnonzero(wide == both)
                for part in _pieces(count[some]):
                    mine = pa.array(some[part])
                    steps, each = _values(posts.take(mine), f"u{both // 16}")
                    away = np.cumsum(steps, dtype=steps.dtype)
                    begins = np.cumsum(each) - each
                    away -= np.repeat(away[begins] - steps[begins], each)
                    place, _ = _values(places.take(mine), f"u{both % 16}")
                    found = np.empty(len(away), PLACE)
                    found["key"] = (np.repeat(base.to_numpy()[some[part]].view(np.uint64), each) + away.astype(np.uint64)).view(np.int64)
                    found["id"] = np.repeat(ids.to_numpy()[some[part]], each)
                    found["place"] = place
                    held.append(found)
                    rows += len(found)
                    if rows >= MEET_ROWS:
                        yield _by_block(np.concatenate(held), blocks, False)
                        held, rows = [], 0
        if rows:
            yield _by_block(np.concatenate(held), blocks, False)

    wanted = met.select("id", "base", "wide", "posts", "places")
    return wanted.mapInArrow(run, "block long, among boolean, rows binary")


def _block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _by_block(found: np.ndarray, blocks: int, among: bool) -> pa.RecordBatch:
    """Places, or keys that may be found, as one binary for each block."""
    block = _block_of(np.ascontiguousarray(found if among else found["key"]), blocks)
    order = np.argsort(block, kind="stable")
    own, n = np.unique(block, return_counts=True)
    columns = [pa.array(own), pa.array([among] * len(own), pa.bool_()), _blobs(found[order], np.cumsum(n))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "among", "rows"])


def _gathered(dealt: DataFrame, among: DataFrame | None, blocks: int, tasks: int) -> DataFrame:
    """(block, rows): all places of each block in order of key, of the posts of ``among`` only; one row for each block."""
    limited = among is not None

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _by_block(batch.column(0).to_numpy().astype(np.int64), blocks, True)

    def whole(block: int, held: list[np.ndarray], kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(held) if held else np.empty(0, PLACE)
        if limited:
            found = found[np.isin(found["key"], np.concatenate(kept))] if kept else found[:0]
        if len(found):
            found = found[np.argsort(found["key"], kind="stable")]
            yield pa.RecordBatch.from_arrays([pa.array([block]), _blobs(found, np.array([len(found)]))], names=["block", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, kept = None, [], []
        for batch in batches:
            for i, (now, is_among) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if now != block:
                    if block is not None:
                        yield from whole(block, held, kept)
                    block, held, kept = now, [], []
                part = batch.column(2).slice(i, 1)
                (kept if is_among else held).append(_values(part, np.int64 if is_among else PLACE)[0].copy())
        if block is not None:
            yield from whole(block, held, kept)

    if limited:
        wanted = among.select(F.col("key").cast("long").alias("key")).where("key IS NOT NULL")
        dealt = dealt.unionByName(wanted.mapInArrow(keys, "block long, among boolean, rows binary"))
    return dealt.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, "block long, rows binary")


def _search_pass(places: DataFrame, slots: DataFrame, near: DataFrame, k: int, attributes: int) -> DataFrame:
    """The best posts of every query and task, of the blocks ``places`` (block, rows), queries as ``slots`` (query_id, i, slot)
    and ``near`` (slot, id, typos)."""
    spark = places.sparkSession
    said, terms = slots.orderBy("query_id", "i").toArrow(), near.orderBy("id").toArrow()  # at most about NEAR_ROWS
    ids = said["query_id"].combine_chunks().unique()
    names = said["slot"].combine_chunks().unique()
    number = lambda c: pc.index_in(c, value_set=names).combine_chunks().to_numpy().astype(np.int64)
    owner = pc.index_in(said["query_id"], value_set=ids).combine_chunks().to_numpy()
    known, first = np.unique(terms["id"].to_numpy(), return_index=True)
    asked = spark.sparkContext.broadcast(Asked(
        known, np.append(first, len(terms)), number(terms["slot"]), terms["typos"].to_numpy().astype(np.int64),
        np.searchsorted(owner, np.arange(len(ids) + 1)), number(said["slot"]), len(names),
    ))
    queries = spark.sparkContext.broadcast(ids)
    kind = slots.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.value), k)
        for batch in batches:
            for i in range(batch.num_rows):
                found = _values(batch.column(1).slice(i, 1), PLACE)[0]
                at = np.minimum(np.searchsorted(asked.value.ids, found["id"]), len(asked.value.ids) - 1)
                found = found[asked.value.ids[at] == found["id"]]
                if len(found):
                    key, term, place = (found[c].astype(np.int64) for c in ("key", "id", "place"))
                    Block(asked.value, key, term, place % attributes, place // attributes).meet(best)
        query, *rank = best.rows
        yield pa.RecordBatch.from_arrays([queries.value.take(pa.array(query)), *map(pa.array, rank)], names=["query_id", "typos", "proximity", "attribute", "key"])

    return places.mapInArrow(run, f"query_id {kind}, typos long, proximity long, attribute long, key long")


def _passes(places: DataFrame, slots: DataFrame, near: DataFrame, k: int, attributes: int) -> DataFrame | None:
    """The best posts of all queries, as many at once as have about NEAR_ROWS terms near their words."""
    words_near = near.groupBy("word").agg(F.count("*").alias("m"))
    asked = slots.select(F.explode("of").alias("word"))
    passes = max(1, -(-(asked.join(words_near, "word").agg(F.sum("m")).first()[0] or 0) // NEAR_ROWS))
    found = []
    for i in range(passes):
        some = slots.where(_folder(F.col("query_id"), passes) == i)
        answers = settle(some.select("slot", F.explode("of").alias("word")).distinct().join(near, "word").select("slot", "id", "typos"), "answers")
        answered = some.join(answers.select("slot").distinct(), "slot", "left_semi")
        # a query with a word that no term is near finds nothing
        whole = some.groupBy("query_id").agg(F.count("*").alias("n")).join(answered.groupBy("query_id").agg(F.count("*").alias("n")), ["query_id", "n"])
        whole = settle(some.join(whole, "query_id", "left_semi").select("query_id", "i", "slot"), "whole")
        if whole.isEmpty():
            continue
        answers = answers.join(whole.select("slot").distinct(), "slot", "left_semi")
        found.append(settle(_search_pass(places, whole, answers, k, attributes), "found"))
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0] if found else None


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, among: DataFrame | None = None) -> DataFrame:
    """(query_id, key, typos, proximity, attribute, rank): the k best posts of every query (query_id, query).

    ``among`` is a table (key) of posts that may be found, the result of any filter. A query without words finds nothing.
    """
    _small_batches(spark)
    listed = queries.where("query_id IS NOT NULL").select("query_id", words(F.col("query")).alias("w"))
    asked = settle(listed.select("query_id", F.posexplode("w").alias("i", "word")).distinct(), "asked")
    near = settle(candidates(spark, path, asked), "near")
    sizes = _sizes(spark, path)
    # the words of a place of a query are one, unless rows of different queries have the same query_id
    slots = asked.groupBy("query_id", "i").agg(F.sort_array(F.collect_set("word")).alias("of"))
    slots = settle(slots.select("query_id", "i", "of", F.array_join("of", " ").alias("slot")), "slots")
    ids = settle(near.select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "term-ids")
    # the n-th id of each of m tasks, n * m + task, so that ids are small
    task = F.shiftright("id", 33)
    tasks = (ids.agg(F.max(task)).first()[0] or 0) + 1
    ids = ids.withColumn("id", F.col("id").bitwiseAND(F.lit(2**33 - 1)) * tasks + task)
    blocks, tasks = (max(spark.sparkContext.defaultParallelism, -(-sizes["rows"] // n)) for n in (BLOCK_ROWS, TASK_ROWS))
    met = _met(_read(spark, path, "postings", "term", near), ids, "term")
    places = settle(_gathered(_dealt(met, blocks), among, blocks, tasks), "places")
    near = settle(near.join(ids, "term"), "near-ids")
    found = []
    most = near.agg(F.max("typos")).first()[0]
    for least in sorted({min(1, most), most}) if most is not None else []:
        close, last = near.where(F.col("typos") <= least), least == most
        now = _passes(places, slots, close, k, sizes["attributes"])
        if now is None:
            continue
        now = settle(now, "found")
        if last:
            found.append(now)
            continue
        # k posts with so few typing errors leave no place for others; so does a query whose words have no other terms
        more = near.where(F.col("typos") > least).select("word").distinct()
        open_ = slots.select("query_id", F.explode("of").alias("word")).join(more, "word", "left_semi").select("query_id").distinct()
        best = now.where(F.col("typos") <= least).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        open_ = settle(open_.join(best, "query_id", "left_anti"), "open")
        found.append(now.join(open_, "query_id", "left_anti"))
        slots = settle(slots.join(open_, "query_id", "left_semi"), "slots")
    kind = sizes["key"]
    if not found:
        id_kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {id_kind}, key {kind}, typos int, proximity int, attribute int, rank int")
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    order = W.partitionBy("query_id").orderBy("typos", "proximity", "attribute", "key")
    ranked = found[0].withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    key = F.when(F.col("key") != NO_KEY, F.col("key")).cast(kind).alias("key")
    return ranked.select("query_id", key, *(F.col(c).cast("int").alias(c) for c in ("typos", "proximity", "attribute")), "rank")
