"""Words and word hashes of whole Arrow batches, as numpy arrays.

Separators are ASCII, so UTF-8 bytes can be split without decoding them. A word never crosses a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at once; a longer text is handled alone.
PART_BYTES = 1 << 20
#: The same where every byte and word takes several numbers of 8 bytes and a larger part saves no work.
HASHED_BYTES = 1 << 18
#: The setting that bounds the bytes of a batch on its way to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known family of hashes; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: A random value per byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = next(size for size in (HASHED_BYTES + 1, PART_BYTES + 1, n) if size >= n)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        _powers[base] = table
    return table[:n]


@dataclass
class Words:
    """``data[starts[i]:ends[i]]`` is word i; words ``first[d]`` to ``first[d + 1]`` belong to document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits per word: a polynomial of its bytes, mixed."""
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * _power_table(_BASE, len(self.data)), out=total[1:])
        shift = _power_table(_BASE_INVERSE, len(self.data) + 1)
        return mix((total[self.ends] - total[self.starts]) * shift[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def document(self) -> np.ndarray:
        """The number of each word's document in the batch."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, separator: np.ndarray = SPACE) -> Words:
    data, offsets = text_buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads] = inside[heads]
    finishes[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets))


def map_texts(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``docs.mapInArrow(run, schema)`` with batches of about PART_BYTES.

    Spark's own bound would hand over a whole row group of texts at once, which the executor and its Python worker both
    hold, twice over while the buffers grow. The bound stays in the session, as the result may be computed later; a
    session that has one of its own keeps it.
    """
    if docs.sparkSession.conf.get(BATCH_BYTES, None) is None:
        docs.sparkSession.conf.set(BATCH_BYTES, str(PART_BYTES))
    return docs.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, column: str = "body", limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, whole rows each."""
    sizes = batch.column(column).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words of one document, and the first word of each such window."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(_BASE) + words[i : i + n]
    whole = np.ones(n, bool)
    for end in first[1:-1]:  # windows that would cross from one document to the next
        whole[max(0, end - width + 1) : end] = False
    at = np.flatnonzero(whole)
    return mix(total[at] + np.uint64(width)), at
