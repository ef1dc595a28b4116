from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from govspark.operators import history
from govspark.scratch import run_dir
from govspark.streaming import memory, quota
from govspark.streaming.sink import run_to_table

SCHEMA = "conv_id long, turn int, role string, text string, op string"


def talks():
    words = ["treasury", "vote", "council", "tip", "track"]
    rows = []
    for conv in range(5):
        for turn in range(12):
            text = None if turn == 4 else " " if turn == 7 else f"{words[turn % 5]} {words[(turn * conv) % 5]} said in {turn}"
            rows.append((conv, turn, "user" if turn % 3 == 0 or conv == 4 else "assistant", text, memory.ADD))
    return rows


def states(spark, batches, parts):
    path = run_dir(spark, "messages")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    with quota.rocksdb(spark):
        return run_to_table(memory.conversation_states(stream, parts=parts), "memory")


def same(found, expected):
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("parts, order", [(1, 1), (3, -1)])
def test_any_split_equals_the_batch_operators(spark, parts, order):
    rows = talks()
    split = [rows[1::2], rows[0::2]] if order > 0 else [rows[40:], rows[:15], rows[15:40]]
    found = states(spark, split, parts)
    df = spark.createDataFrame(rows, SCHEMA)
    same(memory.current_transcripts(found), history.history_transcript(df))
    same(memory.current_memories(found), history.memory_recall(df))


def test_forget(spark):
    rows = talks()
    forget = [(1, None, None, None, memory.FORGET), (1, 50, "assistant", "treasury again", memory.ADD), (1, 51, "user", "what of the treasury", memory.ADD)]
    found = states(spark, [rows, forget], 2)
    df = spark.createDataFrame([r for r in rows if r[0] != 1] + forget[1:], SCHEMA)
    same(memory.current_transcripts(found), history.history_transcript(df))
    same(memory.current_memories(found), history.memory_recall(df))
    assert memory.current_transcripts(found).where(F.col("conv_id") == 1).first().transcript.count("\n") == 1


def test_every_core_writes_a_file_of_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "run_dir", lambda spark, name: str(tmp_path / name))
    memory.landed_messages(spark, spark.createDataFrame([(i, 0, "user", "x") for i in range(500)], "conv_id long, turn int, role string, text string"), 2)
    assert len(list((tmp_path / "messages").glob("*.parquet"))) == 2 * spark.sparkContext.defaultParallelism  # 2 in all before


def test_a_part_takes_plain_rows():
    """Without a frame per key and batch, which took most of the time."""

    class Kept:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    part = memory.Conversation(2, 2, None)
    part.state = Kept()
    said = Row("op", "turn", "role", "text", "words")
    rows = [said(memory.ADD, 0, "user", "a b", ["a", "b"]), said(memory.ASK, 3, "user", "b", ["b"]), said(memory.ADD, 1, "bot", "c", ["c"]), said(memory.ADD, 2, "bot", None, [])]
    out = [r.asDict() for r in part.handleInputRows((7, 0), iter(rows), None)]
    assert [(r["kind"], r["turn"], r["overlap"], r["version"]) for r in out] == [("last", 2, None, 1), ("last", 1, None, 1), ("memory", 0, 1, 1), ("touched", None, None, 1)]
    out = list(part.handleInputRows((7, 0), iter([said(memory.ADD, 4, "user", "d", ["d"]), said(memory.FORGET, None, None, None, [])]), None))
    assert [(r["kind"], r["turn"], r["asked"], r["version"]) for r in out] == [("last", 4, None, 2), ("touched", None, None, 2)]
