from __future__ import annotations

import functools
import random

import pytest

from govspark.operators import chunk, combined_chunks, ordered


def files(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2, 6, 12])):
            words = " ".join(rng.choice(["a", "bb", "council", "vote. Then", "x" * 30]) for _ in range(rng.choice([1, 2, 3, 8, 40])))
            parts.append(words + rng.choice(["", "\n", "\n\n", "\n\n\n", "\n\n\n\n\n", " \n"]))
        group = rng.choice(["hot", "hot", "one", "two", None])
        rows.append((i, group, rng.choice(["t", "long title " * 3, "line\n\nbreak"]), rng.choice([None, " \n", "".join(parts), "".join(parts)])))
    return rows


def joined(rows, group):
    mine = sorted(r for r in rows if r[1] == group and r[3] is not None and r[3].strip())
    return "\n".join(f"\n\n--- FILE: {title} ---\n{text}" for _, _, title, text in mine)


def expected(rows, size, overlap):
    out = {}
    for group in {r[1] for r in rows}:
        text = joined(rows, group)
        chunks = [c for c in (c.strip() for c in chunk.split_text(text, size, overlap)) if c] if text else []
        out |= {(group, i): (len(chunks), len(c), len(c) // 4, c) for i, c in enumerate(chunks)}
    return out


@pytest.mark.parametrize("size, overlap, block", [(30, 8, 1), (30, 8, 700), (60, 59, 1), (25, 0, 400), (40, 20, 10**7), (400, 100, 1)])
def test_chunks_are_those_of_the_joined_text(spark, monkeypatch, size, overlap, block):
    monkeypatch.setattr(combined_chunks, "FAN_IN", 3)
    rows = files(seed=size + overlap)
    df = spark.createDataFrame(rows, "i long, source string, title string, body string").repartition(4)
    found = combined_chunks.chunk_combined(df, "i", "title", "body", "source", size, overlap, block).collect()
    got = {(r.source, r.chunk_index): (r.total_chunks, r.chunk_size, r.chunk_tokens, r.content) for r in found}
    assert len(got) == len(found) and got == expected(rows, size, overlap)


def test_groups_too_long_for_a_window(spark, monkeypatch):
    """The sums of long groups, by which chunks find their place, come from parts."""
    monkeypatch.setattr(combined_chunks, "running", functools.partial(ordered.running, window_bytes=2_000))
    rows = files(300, seed=5)
    df = spark.createDataFrame(rows, "i long, source string, title string, body string").repartition(4)
    found = combined_chunks.chunk_combined(df, "i", "title", "body", "source", 30, 8, 700).collect()
    got = {(r.source, r.chunk_index): (r.total_chunks, r.chunk_size, r.chunk_tokens, r.content) for r in found}
    assert len(got) == len(found) and got == expected(rows, 30, 8)


def test_ways_that_never_meet(spark, monkeypatch):
    """Equal segments keep all ways in apart, so that every block depends on the one before."""
    monkeypatch.setattr(combined_chunks, "FAN_IN", 2)
    rows = [(i, "g", "t", "y" * 20) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, source string, title string, body string")
    found = combined_chunks.chunk_combined(df, "i", "title", "body", "source", 40, 10, 1).collect()
    assert {("g", r.chunk_index): (r.total_chunks, r.chunk_size, r.chunk_tokens, r.content) for r in found} == expected(rows, 40, 10)


def test_all_files_and_no_file(spark):
    rows = [(i, None, t, b) for i, _, t, b in files(80)]
    df = spark.createDataFrame(rows, "i long, source string, title string, body string")
    found = combined_chunks.chunk_combined(df, "i", "title", "body", size=30, overlap=8, block_chars=500)
    assert found.columns == ["chunk_index", "total_chunks", "chunk_size", "chunk_tokens", "content"]
    assert {(None, r.chunk_index): tuple(r)[1:] for r in found.collect()} == expected(rows, 30, 8)
    assert combined_chunks.chunk_combined(df.limit(0), "i", "title", "body", "source").collect() == []
