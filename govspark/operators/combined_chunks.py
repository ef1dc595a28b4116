"""Chunks, with overlap, of combined documents of any size.

A combined document is a sequence of files, each behind a blank line. It is cut at blank lines into segments; runs of
segments shorter than a chunk are merged greedily, longer ones are chunked on their own. Where a chunk ends depends on
where the one before it ended, but on nothing else: a chunk that ends before segment ``i`` fixes by itself where the next
one begins. So a document is dealt to blocks by its characters, with as many characters before each as a chunk can reach
back:

1. every block finds, for each place where a chunk may have ended last before it, the last such place inside it; most blocks
   see a segment too long to merge, or the paths meet, and give one place only;
2. these small tables are put together in a tree, so that every block learns where the chunk before it ended;
3. every block writes the chunks that end in it.

No document, and no list of its segments, ever meets in one task; the chunks are those of the joined text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.documents import file_pieces
from govspark.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS, quarter_length, quarter_weight, split_text
from govspark.operators.ordered import positions, running
from govspark.scratch import settle

#: Characters of a block, and blocks that are put together at once.
BLOCK_CHARS, FAN_IN = 4_000_000, 1000
CHARS_PER_TOKEN = 4
#: Rows of a small table that travel to every task.
TRAVEL_ROWS = 200_000
#: The place of a block whose way in makes no difference.
ANY = -1


def segments(text: str, mark: str = SEPARATORS[0]) -> list[str]:
    first, *rest = text.split(mark)
    return [p for p in (first, *(mark + r for r in rest)) if p]


@dataclass
class Path:
    """Segments of a block and of the characters before it: where they begin, and where chunks end.

    A place is ``2 * character + kind``: of kind 1, a chunk ended before the segment at that character and the next one begins
    with what overlaps; of kind 0, a chunk begins there anew. ``known`` tells whether the first segment begins the document.
    """

    lengths: np.ndarray
    begin: int
    size: int
    overlap: int

    def __post_init__(self) -> None:
        n = len(self.lengths)
        self.starts = self.begin + np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.long = np.append(self.lengths >= self.size, False)
        at = np.arange(n + 1)
        after_long = np.maximum.accumulate(np.where(np.concatenate([[False], self.long[:-1]]), at, 0))
        self.next_long = np.minimum.accumulate(np.where(self.long, at, n)[::-1])[::-1]
        room = np.minimum(self.overlap, self.size - np.append(self.lengths, 0))
        #: first segment of a chunk that begins after one ended before segment i
        self.first = np.maximum(np.searchsorted(self.starts, self.starts - room), after_long)

    def end(self, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the chunk ends that begins with segment ``first`` and holds ``at``: the segment it ends before."""
        full = np.searchsorted(self.starts, self.starts[first] + self.size, side="right") - 1
        return np.minimum(np.maximum(full, at + 1), np.maximum(self.next_long[at], at))

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """(the state after each state, the segment before which its chunk ends); state 2 i + kind is at segment i."""
        at = np.arange(len(self.lengths) + 1)
        ends = np.stack([self.end(at, at), self.end(self.first, at)], 1)
        ends[-1] = len(self.lengths)
        after = np.where(self.long[ends], 2 * (ends + 1), 2 * ends + 1)
        own = 2 * at[:, None] + np.arange(2)
        return np.where(ends >= len(self.lengths), own, after).ravel(), ends.ravel()

    def last(self, states: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The last state on the way from each, by doubling."""
        while True:
            onward = after[after]
            if (onward == after).all():
                return after[states]
            after = onward

    def place(self, state: np.ndarray) -> np.ndarray:
        return 2 * self.starts[state // 2] + state % 2

    def state(self, place: int) -> int:
        at = int(np.searchsorted(self.starts, place // 2))
        if self.starts[at] != place // 2:
            raise ValueError("a block was entered at a place it does not know")
        return 2 * at + place % 2

    def ways_in(self, own: int) -> np.ndarray:
        """States before segment ``own`` whose chunk ends there or later; one only where the way in makes no difference."""
        before = np.flatnonzero(self.long[:own])
        after, ends = self.steps()
        if self.begin == 0 or len(before):
            state = 2 * (before[-1] + 1) if len(before) else 0
            while ends[state] < own and after[state] != state:
                state = after[state]
            return np.array([state])
        at = np.flatnonzero(self.starts[:own] - self.overlap >= self.begin)
        return (2 * at + 1)[ends[2 * at + 1] >= own]


def _tail(ends: np.ndarray, reach: int) -> int:
    """How many segments of a file no later block needs: the others hold ``reach`` characters or more, or are all."""
    return int(np.searchsorted(ends, ends[-1] - reach, side="right"))


def _lengths_in_document(own: np.ndarray, lead: int, trail: int) -> np.ndarray:
    """Lengths of a file's segments behind ``lead`` more line breaks and before ``trail``, which make blank lines in pairs."""
    out = np.concatenate([np.full(lead // 2, 2), own, np.full(trail // 2, 2)]).astype(np.int64)
    out[lead // 2] += lead % 2
    out[-1] += trail % 2
    return out


class Deal:
    """The blocks of a file by its place in the order, of groups of several blocks; any other group is one block."""

    def __init__(self, bounds: list) -> None:
        held: dict[str, list] = {}
        for key, *row in bounds:
            held.setdefault(key, []).append(row)
        self.groups = {key: [np.array(c) for c in zip(*sorted(rows))] for key, rows in held.items()}

    def __call__(self, key: str, at: float) -> list[int]:
        """The file's own block, then those whose characters before them it reaches into."""
        if key not in self.groups:
            return [0]
        blocks, own, back = self.groups[key]
        home = max(0, int(np.searchsorted(own, at, side="right")) - 1)
        return blocks[home : max(home + 1, int(np.searchsorted(back, at, side="right")))].tolist()


def _bounds(places: DataFrame, reach: int, block: int) -> list:
    """(key, block, first place of its own, first place that it sees) of groups of several blocks.

    Files at one place, if there are any, stay together.
    """
    ties = places.groupBy("key", "at").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ties = ties.withColumn("home", F.expr(f"start div {block}"))
    own = ties.groupBy("key", F.col("home").alias("block")).agg(F.min("at").alias("own"))
    own = settle(own.join(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi"), "chunk-blocks")
    low, high = F.expr(f"greatest(home + 1, end div {block})"), F.expr(f"(end + {reach}) div {block}")
    seen = ties.select("key", "at", F.explode(F.when(low <= high, F.sequence(low, high))).alias("block"))
    back = seen.groupBy("key", "block").agg(F.min("at").alias("back"))
    return [tuple(r) for r in own.join(back, ["key", "block"], "left").select("key", "block", "own", F.least("own", "back")).collect()]


def _spread_lengths(places: DataFrame, deal: Broadcast, reach: int) -> DataFrame:
    """Each file's segment lengths at its block and, its end only, at the blocks whose characters before them it reaches into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, at, start, lead, trail, last, lengths in zip(*(batch[c] for c in ("key", "at", "start", "lead", "trail", "last", "lengths"))):
                home, *others = deal.value(key, at)
                whole = (False, start, lead, _lengths_in_document(lengths, lead, trail))
                out.append((key, home, True, last, *whole))
                if others:
                    ends = np.cumsum(lengths, dtype=np.int64)
                    dropped = _tail(ends, reach)
                    tail = (True, start + lead + int(ends[dropped - 1]), 0, lengths[dropped:]) if dropped else whole
                    out.extend((key, other, False, last, *tail) for other in others)
            yield pd.DataFrame(out, columns=["key", "block", "own", "last", "cut", "start", "lead", "lengths"])

    return places.mapInPandas(run, "key string, block long, own boolean, last boolean, cut boolean, start long, lead long, lengths array<long>")


def _spread_texts(pieces: DataFrame, deal: Broadcast, reach: int) -> DataFrame:
    """The files themselves, dealt in the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            dealt = [deal.value(k, at) for k, at in zip(columns["key"].to_pylist(), columns["at"].to_numpy(zero_copy_only=False))]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([d[0] for d in dealt], pa.int64()), pa.array([True] * n, pa.bool_()), pa.array([False] * n, pa.bool_())],
                names=names,
            )
            for i, (_, *others) in enumerate(dealt):
                if others:
                    text = columns["piece"][i].as_py()
                    ends = np.cumsum([len(p) for p in segments(text.rstrip("\n"))])
                    dropped = _tail(ends, reach)
                    row = [pa.array([text[ends[dropped - 1] :] if dropped else text], c.type) if x == "piece" else c.slice(i, 1) for x, c in columns.items()]
                    for other in others:
                        yield pa.RecordBatch.from_arrays([*row, pa.array([other], pa.int64()), pa.array([False]), pa.array([dropped > 0])], names=names)

    names = [*pieces.columns, "block", "own", "cut"]
    kinds = ", ".join(f"{c} {kind}" for c, kind in pieces.dtypes)
    return pieces.mapInArrow(run, f"{kinds}, block long, own boolean, cut boolean")


def _visible(group: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The rows of a block in order, from the last one that holds all a chunk can reach back."""
    group = group.sort_values(by, kind="stable")
    cut = np.flatnonzero(group["cut"])
    return group.iloc[cut[-1] :] if len(cut) else group


def _compose(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """One table (ways in, ways out) for several blocks in a row."""
    ways, out = tables[0]
    for inner, outer in tables[1:]:
        if inner[0] == ANY:
            out = np.array([outer[0]])
            break_at = True
        else:
            known = dict(zip(inner.tolist(), outer.tolist()))
            out, break_at = np.array([known[x] for x in out.tolist()]), False
        if break_at or len(set(out.tolist())) == 1:
            ways, out = np.array([ANY]), out[:1]
    return ways.tolist(), out.tolist()


def _tables(group: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(a), np.asarray(b)) for a, b in zip(group["ways"], group["out"])]


def _entries(tables: DataFrame, rank: str = "rank") -> DataFrame:
    """(key, rank, entry): where the chunk before each block ended; ``tables`` are (key, rank, ways, out, entry)."""

    def along(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        place, entries = None, []
        for way, ways, out in zip(group["entry"], group["ways"], group["out"]):
            place = way if place is None and not pd.isna(way) else place
            entries.append(int(place) if place is not None else ANY)
            place = out[0] if ways[0] == ANY else dict(zip(ways, out))[place]
        return pd.DataFrame({"key": group["key"], "rank": group["rank"], "entry": entries})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        ways, out = _compose(_tables(group))
        return pd.DataFrame({"key": group["key"].iloc[:1], "rank": group["upper"].iloc[:1], "ways": [ways], "out": [out], "entry": [None]})

    of = ((F.col("rank") - 1) / FAN_IN).cast("long") + 1
    if (tables.agg(F.max("rank")).first()[0] or 0) > FAN_IN:
        upper = tables.withColumn("upper", of)
        above = settle(upper.groupBy("key", "upper").applyInPandas(together, "key string, rank long, ways array<long>, out array<long>, entry long"), "chunk-ways")
        known = _entries(above).select("key", F.col("rank").alias("upper"), F.col("entry").alias("known"))
        first = (F.col("rank") - 1) % FAN_IN == 0
        joined = upper.drop("entry").join(known, ["key", "upper"]).withColumn("entry", F.when(first, F.col("known")))
        return settle(joined.groupBy("key", "upper").applyInPandas(along, "key string, rank long, entry long"), "chunk-entries")
    return settle(tables.groupBy("key").applyInPandas(along, "key string, rank long, entry long"), "chunk-entries")


def _named(files: DataFrame, group: str | None) -> Column:
    """The group as a text that is never null."""
    if group is None:
        return F.lit("")
    return F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))


def combined_files(files: DataFrame, order: str, title: str, content: str, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files of the joined texts, (key, at, nth, digest, piece), and their places, (key, at, lengths, lead, trail, last, start, end).

    Files are joined by line breaks. Line breaks at the end of a file go over to the next one, so that a run of line breaks,
    which makes blank lines from left to right, is never cut: ``lead`` are those before a file, ``trail`` those that stay at its
    end. Places come from the lengths of the files' segments alone, so no text is moved for them. ``nth`` is the order, ``at``
    the same as a number; files of one ``nth`` are told by their ``digest``.
    """
    pieces = file_pieces(files.withColumn("_key", _named(files, group)), "_key", order, title, content).where("piece IS NOT NULL")
    place = F.unix_micros(F.col(order).cast("timestamp")) if dict(files.dtypes)[order].startswith("timestamp") else F.col(order)
    at = F.coalesce(place.cast("double"), F.lit(float("-inf")))
    pieces = pieces.select(F.col("_key").alias("key"), at.alias("at"), F.col(order).alias("nth"), F.xxhash64("piece").alias("digest"), "piece")
    kept = F.rtrim(F.col("piece"), F.lit("\n"))
    # a piece begins with the first separator
    lengths = F.transform(F.split(kept, SEPARATORS[0]), lambda p: F.length(p).cast("bigint") + len(SEPARATORS[0]))
    sized = pieces.select(
        "key", "at", "nth", "digest", F.slice(lengths, F.lit(2), F.size(lengths)).alias("lengths"),
        F.length("piece").cast("bigint").alias("chars"), (F.length("piece") - F.length(kept)).cast("bigint").alias("breaks"),
    )
    sized = settle(sized, "combined-lengths")
    numbered = running(sized, ["key"], ["nth", "digest"], {"n": F.lit(1).cast("bigint"), "upto": F.col("chars") + 1}, totals=True)
    numbered = settle(numbered, "combined-files")
    before = numbered.select("key", (F.col("n") + 1).alias("n"), F.col("breaks").alias("moved"))
    joined = numbered.join(before, ["key", "n"], "left").withColumn("lead", F.when(F.col("n") > 1, F.coalesce("moved", F.lit(0)) + 1).otherwise(0).cast("bigint"))
    last = F.col("n") == F.col("n_total")
    joined = joined.withColumn("start", F.col("upto") - F.col("chars") - 1 - F.col("lead")).withColumn("trail", F.when(last, F.col("breaks")).otherwise(0))
    end = F.col("start") + F.col("lead") + F.col("chars") - F.col("breaks") + F.col("trail")
    return pieces, settle(joined.select("key", "at", "lengths", "lead", "trail", last.alias("last"), "start", end.alias("end")), "combined-places")


def chunk_combined(
    files: DataFrame,
    order: str,
    title: str,
    content: str,
    group: str | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(group, chunk_index, total_chunks, chunk_size, chunk_tokens, content): the chunks of each group's combined document.

    They are those that ``chunk_recursive`` gives of the joined text; four characters make a token. ``order`` is unique in a
    group, numeric or a timestamp. Without a group all files make one document.
    """
    how = {"size": size * CHARS_PER_TOKEN, "overlap": overlap * CHARS_PER_TOKEN}
    reach = 2 * how["size"] + how["overlap"]
    block = max(block_chars, reach + 1)
    pieces, places = combined_files(files, order, title, content, group)
    deal = files.sparkSession.sparkContext.broadcast(Deal(_bounds(places, reach, block)))

    def ways(one: pd.DataFrame) -> pd.DataFrame:
        seen = _visible(one, ["start"])
        begin, own_start = int(seen["start"].iloc[0]), int(seen.loc[seen["own"], "start"].iloc[0])
        path = Path(np.concatenate([np.asarray(x, np.int64) for x in seen["lengths"]]), begin, **how)
        own = int(np.searchsorted(path.starts, own_start))
        entries = path.ways_in(own)
        out = path.place(path.last(entries, path.steps()[0]))
        places = path.place(entries)
        if len(set(out.tolist())) == 1:
            places, out = (np.array([ANY]) if len(places) > 1 else places), out[:1]
        table = pd.DataFrame({"key": one["key"].iloc[:1].to_numpy(), "block": one["block"].iloc[:1].to_numpy()})
        # a block that knows its own way in does not depend on the one before
        known = path.begin == 0 or path.long[:own].any()
        table["ways"], table["out"] = [[ANY] if known else places.tolist()], [out.tolist()]
        final = bool(seen.loc[seen["own"], "last"].any())
        return table.assign(begin=begin, lead=int(seen["lead"].iloc[0]), own_start=own_start, final=final)

    tables = _spread_lengths(places, deal, reach).groupBy("key", "block").applyInPandas(
        ways, "key string, block long, ways array<long>, out array<long>, begin long, lead long, own_start long, final boolean"
    )
    ranked = settle(positions(settle(tables, "chunk-tables"), ["key"], ["block"], "rank"), "chunk-tables")
    entries = _entries(ranked.select("key", "rank", "ways", "out", F.lit(None).cast("long").alias("entry")))
    entries = entries.join(ranked, ["key", "rank"]).select("key", "block", "entry", "begin", "lead", "own_start", "final")

    def write(one: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found: list[str] = []
        if len(one):
            seen, place = _visible(one, ["at", "nth", "digest"]), known.iloc[0]
            final = bool(place["final"])
            text = "\n" * int(place["lead"]) + "\n".join(seen["piece"])
            pieces = segments(text if final else text.rstrip("\n"))
            path, n = Path(np.array([len(p) for p in pieces], np.int64), int(place["begin"]), **how), len(pieces)
            own = int(np.searchsorted(path.starts, int(place["own_start"])))
            after, ends = path.steps()
            state = int(path.ways_in(own)[0]) if path.begin == 0 or path.long[:own].any() else path.state(int(place["entry"]))
            while True:
                at, end = state // 2, int(ends[state])
                first = at if state % 2 == 0 else int(path.first[at])
                if end >= n and not final:
                    break
                found.append("".join(pieces[first:end]))
                if end >= n:
                    break
                if path.long[end]:
                    found.extend(split_text(pieces[end], size, overlap, quarter_weight, SEPARATORS[1:]))
                state = int(after[state])
        found = [c for c in (c.strip() for c in found) if c]
        key, place = (one["key"].iloc[0], one["block"].iloc[0]) if len(one) else ("", 0)
        rows = [(key, place, i, quarter_length(c), c) for i, c in enumerate(found)]
        return pd.DataFrame(rows, columns=["key", "block", "seq", "chunk_tokens", "content"], dtype=None if rows else object)

    cut = _spread_texts(pieces, deal, reach).groupBy("key", "block").cogroup(entries.groupBy("key", "block"))
    chunks = settle(cut.applyInPandas(write, "key string, block long, seq int, chunk_tokens int, content string"), "combined-chunks")
    counts = running(chunks.groupBy("key", "block").agg(F.count("*").alias("m")), ["key"], ["block"], {"upto": F.col("m")}, totals=True)
    counts = settle(counts, "chunk-counts")
    numbered = chunks.join(F.broadcast(counts) if counts.count() <= TRAVEL_ROWS else counts, ["key", "block"])
    name = [F.when(F.col("key") != "", F.expr("substr(key, 2)")).cast(files.schema[group].dataType).alias(group)] if group else []
    return numbered.select(
        *name,
        (F.col("upto") - F.col("m") + F.col("seq")).cast("int").alias("chunk_index"),
        F.col("upto_total").cast("int").alias("total_chunks"),
        F.length("content").alias("chunk_size"),
        "chunk_tokens",
        "content",
    )
