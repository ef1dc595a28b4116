"""Conversations as a stream: the last messages and the recalled memories of each, kept as state.

Every message is kept in one of ``parts`` states of its conversation, by its turn, so that a busy conversation is no single
task; a user's message is a question to all parts. A part keeps its newest messages, its memories and the newest question; a
state may expire. After every micro-batch each part that was touched hands out its newest messages and its best memories for
the question, under a version that counts up; ``current_...`` put the last versions of the parts together. So the state after
any split of the messages into batches, in any order, is that of the batch operators. ``forget`` clears a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from govspark.functions.text import strip
from govspark.operators.history import HISTORY, MEMORIES, history_transcript, memory_text
from govspark.operators.search import tokens
from govspark.scratch import run_dir

ADD, ASK, FORGET = "add", "ask", "forget"
PARTS = 4
#: What a part hands out: newest messages, memories, or, with neither, that it was touched.
LAST, MEMORY, TOUCHED = "last", "memory", "touched"
OUTPUT = "conv_id bigint, part int, kind string, turn bigint, role string, text string, overlap int, asked bigint, version bigint"
HANDED = Row(*(c.split()[0] for c in OUTPUT.split(", ")))


STATE = (
    "last array<struct<turn:bigint,role:string,text:string>>, asked bigint, wanted array<string>, "
    "memories array<struct<turn:bigint,text:string,words:array<string>>>, version bigint"
)


class Conversation(StatefulProcessor):
    """One state per part, as every call to the store costs a round trip: read and written once for a batch's rows."""

    def __init__(self, keep: int, memories: int, expiry_ms: int | None) -> None:
        self.keep, self.best, self.expiry = keep, memories, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("conversation", STATE, self.expiry)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, asked, wanted, memories, version = self.state.get() or ([], None, [], [], 0)
        newest = [tuple(m) for m in last]
        known = {m[0]: (m[1], list(m[2])) for m in memories}
        for row in sorted(rows, key=lambda r: r["op"] != FORGET):  # what comes with it is said after it
            op, turn, words = row["op"], row["turn"], row["words"]
            if op == FORGET:
                newest, known, asked, wanted = [], {}, None, []
            elif op == ASK:
                if asked is None or turn >= asked:
                    asked, wanted = int(turn), list(words)
            else:
                newest.append((int(turn), row["role"], row["text"]))
                if len(words):
                    known[int(turn)] = (row["text"], list(words))
        newest = sorted(newest, key=lambda m: -m[0])[: self.keep]
        self.state.update((newest, asked, list(wanted), [(turn, *m) for turn, m in known.items()], version + 1))
        for turn, role, text in newest:
            yield HANDED(*key, LAST, turn, role, text, None, asked, version + 1)
        if asked is not None:
            of = set(wanted)
            found = [(len(of.intersection(words)), turn, text) for turn, (text, words) in known.items() if turn < asked]
            for n, turn, text in sorted((f for f in found if f[0]), key=lambda f: (-f[0], -f[1]))[: self.best]:
                yield HANDED(*key, MEMORY, turn, None, text, n, asked, version + 1)
        yield HANDED(*key, TOUCHED, None, None, None, None, asked, version + 1)

    def close(self) -> None:
        pass


def _events(messages: DataFrame, parts: int) -> DataFrame:
    """A row per message at its part, and per question and per forgetting at every part."""
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    own = F.pmod(F.xxhash64("turn"), F.lit(parts)).cast("int")

    kinds = F.when(F.col("op") == FORGET, F.transform(every, lambda p: F.struct(p.alias("part"), F.lit(FORGET).alias("op")))).otherwise(
        F.concat(
            F.array(F.struct(own.alias("part"), F.lit(ADD).alias("op"))),
            F.when(F.col("role") == "user", F.transform(every, lambda p: F.struct(p.alias("part"), F.lit(ASK).alias("op")))).otherwise(F.array().cast("array<struct<part:int,op:string>>")),
        )
    )
    words = F.when(strip(F.coalesce("text", F.lit(""))) != "", tokens(F.col("text"))).otherwise(F.array().cast("array<string>"))
    spread = messages.withColumn("words", words).withColumn("e", F.explode(kinds))
    return spread.select("conv_id", "e.part", "e.op", F.col("turn").cast("bigint").alias("turn"), "role", "text", "words")


def conversation_states(messages: DataFrame, keep: int = HISTORY, memories: int = MEMORIES, parts: int = PARTS, expiry_ms: int | None = None) -> DataFrame:
    """What the parts hand out, of a stream of messages (conv_id, turn, role, text and, if there are commands, op). Needs the
    RocksDB state store."""
    commands = messages if "op" in messages.columns else messages.withColumn("op", F.lit(ADD))
    states = _events(commands, parts).groupBy("conv_id", "part")
    return states.transformWithState(Conversation(keep, memories, expiry_ms), OUTPUT, "append", "processingTime" if expiry_ms else "none")


def _newest(states: DataFrame) -> DataFrame:
    """What each part handed out last."""
    last = states.where(F.col("kind") == TOUCHED).groupBy("conv_id", "part").agg(F.max("version").alias("version"))
    return states.join(last, ["conv_id", "part", "version"])


def current_transcripts(states: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(conv_id, transcript) of the last messages of each conversation; ``states`` is a table of all that was handed out."""
    rows = _newest(states).where(F.col("kind") == LAST)
    return history_transcript(rows.select("conv_id", "turn", "role", "text"), keep)


def current_memories(states: DataFrame, memories: int = MEMORIES) -> DataFrame:
    """(conv_id, memory) for the last question of each conversation."""
    rows = _newest(states).where(F.col("kind") == MEMORY)
    return memory_text(rows.select("conv_id", "turn", "text", "overlap"), memories)


def landed_messages(spark: SparkSession, messages: DataFrame, batches: int) -> DataFrame:
    """A stream of stored messages in so many batches, dealt without regard to their order; each core writes a file of each."""
    path, files = run_dir(spark, "messages"), spark.sparkContext.defaultParallelism
    messages.repartition(batches * files, F.xxhash64("conv_id", "turn")).write.parquet(path)
    return spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", files).parquet(path)
