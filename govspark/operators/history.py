"""Windows over conversations. Each keeps a few rows per conversation before rows move between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.functions.text import let, strip, truncated
from govspark.operators.joins import salted_join
from govspark.operators.search import tokens

# Messages of history, their cut, topics, recalled memories.
HISTORY, HISTORY_CUT = 5, 200
TOPIC_MESSAGES, MIN_TOPIC, TOPIC_CUT = 3, 10, 100
MEMORIES = 5


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def _in_order(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("turn", *fields)))


def history_transcript(messages: DataFrame, n: int = HISTORY, cut: int = HISTORY_CUT) -> DataFrame:
    """The last messages of each conversation as numbered lines."""
    grouped = last_messages(messages, n).groupBy("conv_id").agg(_in_order("role", "text").alias("rows"))
    line = F.transform(
        "rows",
        lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), F.initcap(m["role"]), F.lit(": "), truncated(m["text"], cut, "...")),
    )
    return grouped.select("conv_id", F.array_join(line, "\n").alias("transcript"))


def recent_user_topics(messages: DataFrame) -> DataFrame:
    """What the user said in the last messages, cut short."""
    said = last_messages(messages, TOPIC_MESSAGES).where((F.col("role") == "user") & (F.length("text") > MIN_TOPIC))
    grouped = said.groupBy("conv_id").agg(_in_order("text").alias("rows"))
    cut = F.transform("rows", lambda m: F.left(m["text"], F.lit(TOPIC_CUT)))
    return grouped.select("conv_id", F.array_join(cut, "; ").alias("topics"))


def memory_recall(messages: DataFrame, k: int = MEMORIES) -> DataFrame:
    """For the last question of each conversation, the earlier messages that share most words with it, as bullets."""
    asked = messages.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.max_by(F.struct("turn", "text"), "turn").alias("asked")
    )
    words = tokens(F.col("asked.text"))
    spoken = messages.where(strip(F.col("text")) != "").select("conv_id", "turn", "text")
    earlier = salted_join(spoken, asked, "conv_id").where(F.col("turn") < F.col("asked.turn"))
    scored = earlier.select("conv_id", "turn", "text", F.size(F.array_intersect(tokens(F.col("text")), words)).alias("overlap"))
    return memory_text(scored, k)


def memory_text(scored: DataFrame, k: int = MEMORIES) -> DataFrame:
    """The best messages (conv_id, turn, text, overlap) of each conversation as bullets."""
    best = W.partitionBy("conv_id").orderBy(F.col("overlap").desc(), F.col("turn").desc())
    top = scored.where(F.col("overlap") > 0).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    grouped = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("rows"))
    bullets = F.array_join(F.transform("rows", lambda m: F.concat(F.lit("- "), m["text"])), "\n")
    return grouped.select("conv_id", F.concat(F.lit("Previous relevant interactions:\n"), bullets, F.lit("\n\n")).alias("memory"))


def trim_to_budget(text: Column, markers: list[str], budget: int, section: int = 10, longest: int = 200) -> Column:
    """The lines that fit a budget of characters: marked sections first, then the shorter lines; no line twice.

    A section is a line with a marker and the lines after it, ``section`` in all. A line that does not fit is skipped
    and later ones are still tried.
    """
    def in_order(rows: Column, marked: Column) -> Column:
        near = F.transform(
            marked,
            lambda _, i: F.array_contains(F.slice(marked, F.greatest(i - section + 2, F.lit(1)), F.least(i + 1, F.lit(section))), True),
        )
        pairs = F.zip_with(rows, near, lambda r, f: F.struct(r.alias("line"), f.alias("first")))
        first = F.filter(pairs, lambda p: p["first"])
        rest = F.filter(pairs, lambda p: ~p["first"] & (F.length(p["line"]) < longest))
        return F.array_distinct(F.transform(F.concat(first, rest), lambda p: p["line"]))

    def has_marker(row: Column) -> Column:
        return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(row, m))

    candidates = let(F.split(text, "\n"), lambda rows: let(F.transform(rows, has_marker), lambda marked: in_order(rows, marked)))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("lines"))

    def add(state: Column, line: Column) -> Column:
        used = state["used"] + F.length(line) + 1
        taken = F.struct(used.alias("used"), F.array_append(state["lines"], line).alias("lines"))
        return F.when(used < budget, taken).otherwise(state)

    return F.array_join(F.aggregate(candidates, start, add, lambda s: s["lines"]), "\n")
