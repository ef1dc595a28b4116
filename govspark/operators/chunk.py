"""Documents to chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import text as t
from govspark.operators.ordered import positions

# Separators from coarse to fine, default sizes in tokens.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK_TOKENS = 1000, 200, 50

# Paragraph delimiters from coarse to fine; sizes in characters.
PARAGRAPH_DELIMITERS = ["\n\n\n", "\n\n", "\n---\n", "\n##", "\n#"]
WINDOW_WIDTH, MIN_PIECE, MIN_PARAGRAPH = 3000, 100, 200

#: Characters of texts whose chunks a task holds at once; a longer text is alone.
PART_CHARS = 1_000_000

SECTIONS = ["beginning", "early_middle", "late_middle", "end"]


def quarter_length(text: str) -> int:
    """Token count for want of a tokenizer: four characters per token."""
    return len(text) // 4


def quarter_weight(text: str) -> float:
    """The same without rounding, so that the weights of pieces add up to the weight of their sum."""
    return len(text) / 4


def _merge(pieces: list[str], size: int, overlap: int, count: Callable[[str], float]) -> Iterator[str]:
    """Joins neighbouring pieces up to ``size`` tokens; each chunk starts with up to ``overlap`` tokens of the last."""
    window: deque[tuple[str, float]] = deque()
    total = 0.0
    for piece in pieces:
        cost = count(piece)
        if window and total + cost > size:
            yield "".join(p for p, _ in window)
            while window and (total > overlap or total + cost > size):
                total -= window.popleft()[1]
        window.append((piece, cost))
        total += cost
    if window:
        yield "".join(p for p, _ in window)


def split_text(
    text: str, size: int, overlap: int, count: Callable[[str], float] = quarter_weight, separators: list[str] = SEPARATORS
) -> Iterator[str]:
    """Chunks of one text: cut at the coarsest separator it has, go finer only inside pieces that stay too long."""
    level = next(i for i, s in enumerate(separators) if s in text)
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        first, *rest = text.split(mark)
        pieces = [p for p in (first, *(mark + r for r in rest)) if p]
    else:
        pieces = list(text)
    fitting: list[str] = []
    for piece in pieces:
        if count(piece) < size or not finer:
            fitting.append(piece)
            continue
        yield from _merge(fitting, size, overlap, count)
        fitting = []
        yield from split_text(piece, size, overlap, count, finer)
    yield from _merge(fitting, size, overlap, count)


def chunk_batches(
    batches: Iterator[pa.RecordBatch], split: Callable[[str], Iterator[str]], tokens: Callable[[str], int], part_chars: int = PART_CHARS
) -> Iterator[pa.RecordBatch]:
    """The chunks of batches (doc_id, text, source), handed on whenever those of ``part_chars`` characters are ready."""
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string()]
    names = ["doc_id", "source", "chunk_index", "total_chunks", "chunk_size", "chunk_tokens", "content"]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    for batch in batches:
        rows, held = [], 0
        for doc_id, text, source in zip(*batch.columns):
            text = text.as_py()
            if not text or not text.strip():
                continue
            chunks = [c for c in (c.strip() for c in split(text)) if c]
            key, name = doc_id.as_py(), source.as_py()
            rows.extend((key, name, i, len(chunks), len(c), tokens(c), c) for i, c in enumerate(chunks))
            held += len(text)
            if held >= part_chars:
                yield frame(rows)
                rows, held = [], 0
        yield frame(rows)


def chunk_recursive(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    count: Callable[[str], int] | None = None,
) -> DataFrame:
    """One row per chunk of (doc_id, text, source). Documents are independent, so there is no shuffle.

    ``count`` is a tokenizer's count; without one, four characters make a token. A task holds the chunks of about
    ``PART_CHARS`` characters, however many rows come in one batch.
    """
    weigh, tokens = (count, count) if count else (quarter_weight, quarter_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunk_batches(batches, lambda text: split_text(text, size, overlap, weigh), tokens)

    schema = (
        "doc_id bigint, source string, chunk_index int, total_chunks int, chunk_size int, chunk_tokens int, content string"
    )
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).mapInArrow(run, schema)


def sliding_windows(text: Column, windows: int = 3, width: int = WINDOW_WIDTH) -> Column:
    """Array of ``windows`` slices at even steps, trimmed; short ones are dropped."""
    step = F.floor(F.length(text) / (windows + 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: t.strip(F.substr(text, i * step + 1, F.lit(width))))
    return F.filter(cut, lambda c: F.length(c) > MIN_PARAGRAPH)


def chunk_fixed(documents: DataFrame, windows: int = 3, width: int = WINDOW_WIDTH) -> DataFrame:
    cut = documents.select("doc_id", "source", F.posexplode(sliding_windows(F.col("text"), windows, width)))
    return cut.select("doc_id", "source", F.col("pos").alias("chunk_index"), F.col("col").alias("content"))


def paragraphs(text: Column, width: int = WINDOW_WIDTH, delimiters: list[str] = PARAGRAPH_DELIMITERS) -> Column:
    """Array of paragraphs: the next delimiter is tried only while the first piece is longer than two widths."""
    def finer(mark: str) -> Callable[[Column], Column]:
        def step(pieces: Column) -> Column:
            cut = F.flatten(F.transform(pieces, lambda piece: F.split(piece, f"\\Q{mark}\\E")))
            kept = F.filter(F.transform(cut, t.strip), lambda c: F.length(c) > MIN_PIECE)
            return F.when(F.length(F.get(pieces, F.lit(0))) > 2 * width, kept).otherwise(pieces)

        return step

    pieces = F.array(text)
    for mark in delimiters:
        pieces = t.let(pieces, finer(mark))
    return F.filter(pieces, lambda c: F.length(c).between(MIN_PARAGRAPH, 2 * width))


def meaningful_samples(text: Column, samples: int = 3, width: int = WINDOW_WIDTH, delimiters: list[str] = PARAGRAPH_DELIMITERS) -> Column:
    """Paragraphs, or sliding windows where there are too few of them; at most ``samples``, chosen by hash."""
    chosen = t.let(
        paragraphs(text, width, delimiters),
        lambda found: F.when(F.size(found) >= samples, found).otherwise(sliding_windows(text, samples, width)),
    )
    hashed = F.array_sort(F.transform(chosen, lambda c: F.struct(F.md5(c).alias("h"), c.alias("c"))))
    return F.transform(F.slice(hashed, 1, samples), lambda s: s["c"])


def text_sections(documents: DataFrame) -> DataFrame:
    """Each text in four quarters."""
    length = F.length("text")
    cuts = [F.floor(length * i / 4).cast("int") for i in range(5)]
    quarters = [
        F.struct(F.lit(name).alias("section"), F.substr(F.col("text"), cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("content"))
        for i, name in enumerate(SECTIONS)
    ]
    return documents.select("doc_id", F.inline(F.array(*quarters)))


def section_sample(items: DataFrame, group: str, key: str, per_section: int = 3, seed: str = "seed") -> DataFrame:
    """Items of a group in four sections by position, ``per_section`` of each chosen by hash instead of by chance."""
    from pyspark.sql import Window as W

    numbered = positions(items, [group], [key], "rn", totals=True)
    section = F.least(F.floor((F.col("rn") - 1) / F.greatest(F.lit(1), F.floor(F.col("rn_total") / 4))), F.lit(3))
    sectioned = numbered.withColumn("section", F.get(F.array(*map(F.lit, SECTIONS)), section.cast("int")))
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    best = F.row_number().over(W.partitionBy(group, "section").orderBy(drawn, key))
    return sectioned.withColumn("pick", best).where(F.col("pick") <= per_section).drop("rn", "rn_total")


def with_tokens(chunks: DataFrame, content: str = "content") -> DataFrame:
    return chunks.withColumn("chunk_size", F.length(content)).withColumn("chunk_tokens", t.approx_tokens(F.col(content)))


def filter_by_tokens(chunks: DataFrame, least: int = MIN_CHUNK_TOKENS, most: int = CHUNK_SIZE) -> DataFrame:
    return chunks.where(F.col("chunk_tokens").between(least, most))


def chunk_stats(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Count, sizes and tokens over all chunks or per ``by``."""
    grouped = chunks.groupBy(*([by] if by else []))
    return grouped.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.round(F.avg("chunk_size"), 6).alias("average_chunk_size"),
        F.min("chunk_size").alias("min_chunk_size"),
        F.max("chunk_size").alias("max_chunk_size"),
        F.round(F.avg("chunk_tokens"), 6).alias("average_tokens"),
        F.min("chunk_tokens").alias("min_tokens"),
        F.max("chunk_tokens").alias("max_tokens"),
        F.sum("chunk_tokens").alias("total_tokens"),
    )


def document_stats(documents: DataFrame) -> DataFrame:
    """Documents, characters and mean length per source and for all sources."""
    counted = documents.rollup("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("total_characters"), F.grouping("source").alias("_all")
    )
    return counted.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("source")).alias("source"),
        "documents",
        "total_characters",
        F.floor(F.col("total_characters") / F.col("documents")).alias("average_doc_length"),
    )
