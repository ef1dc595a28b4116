"""Rule-based text classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from govspark.functions.text import strip, word_count

# Words of a greeting and words that show a question about data.
GREETINGS = [
    "hi", "hello", "hey", "greetings", "good morning", "good afternoon", "good evening", "what's up", "whats up",
    "wassup", "howdy", "intro", "introduction", "who are you", "what are you", "what do you do", "what is this", "help",
    "start",
]
DATA_WORDS = [
    "number", "count", "total", "sum", "average", "highest", "lowest", "vote", "votes", "voter", "proposal",
    "referendum", "treasury", "month", "year", "date", "time", "day", "week",
]
MAX_GREETING_WORDS = 3

# Words that send a question to the votes or to the proposals.
VOTING_WORDS = ["voter", "vote", "voting", "delegat", "conviction", "lock period"]
PROPOSAL_WORDS = ["proposal", "referendum", "bounty", "treasury", "motion"]

# Topics by words; the first topic that matches wins.
TOPICS = [
    ("governance", ["governance", "vote", "proposal", "referendum"]),
    ("staking", ["staking", "validator", "nominator"]),
    ("parachain", ["parachain", "slot", "auction"]),
    ("token", ["dot", "token", "price", "economics"]),
]

# Terms looked for in documents.
DOMAIN_TERMS = [
    "parachain", "relay chain", "governance", "staking", "validator", "nominator", "treasury", "referendum", "proposal",
    "council", "DOT", "KSM", "kusama", "democracy", "xcm", "bridge", "consensus", "runtime", "substrate", "crowdloan",
    "auction",
]
MAX_TOPICS = 5


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def is_greeting(text: Column) -> Column:
    """A greeting word alone, or a short message with one and no word about data."""
    said = F.lower(strip(text))
    short = (word_count(said) <= MAX_GREETING_WORDS) & contains_any(said, GREETINGS) & ~contains_any(said, DATA_WORDS)
    return said.isin(GREETINGS) | short


def route(text: Column) -> Column:
    """Data source and table of a question: votes before proposals, everything else is documentation."""
    said = F.lower(text)
    on_votes, on_proposals = contains_any(said, VOTING_WORDS), contains_any(said, PROPOSAL_WORDS)
    return F.struct(
        F.when(on_votes | on_proposals, "ONCHAIN").otherwise("STATIC").alias("data_source"),
        F.when(on_votes, "voting_data").when(on_proposals, "governance_data").alias("table"),
    )


def topic(text: Column) -> Column:
    said = F.lower(text)
    chosen = F.when(F.lit(False), F.lit(""))
    for name, words in TOPICS:
        chosen = chosen.when(contains_any(said, words), name)
    return chosen.otherwise("general")


def topic_terms(content: Column, question: Column, title: Column, terms: list[str] = DOMAIN_TERMS, k: int = MAX_TOPICS) -> Column:
    """Title head and the terms of the content that the question lacks, in order of name, at most ``k``."""
    lowered, asked = F.lower(content), F.lower(question)
    listed = F.array(*[F.lit(term) for term in terms])
    found = F.filter(listed, lambda term: F.contains(lowered, F.lower(term)) & ~F.contains(asked, F.lower(term)))
    head = F.array_compact(F.array(F.when(title != "", F.substring_index(title, " - ", 1))))
    return F.slice(F.array_sort(F.array_distinct(F.concat(head, found))), 1, k)
