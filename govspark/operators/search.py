"""Keyword search over posts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import predicates as p


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def search_filter(equal: dict[str, str | None], tags: str | None = None, any_of: list[str] | None = None) -> Column:
    """AND of the equality filters that have a value, AND any of the tags."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    if tags and any_of:
        conditions.append(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, any_of))))
    return p.all_of(*conditions)


def matched_words(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text. A plain substring test comes first; only where it holds are the word
    borders looked at, so most texts are never cut into words."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [
        F.contains(lowered, F.lit(w)) & lowered.rlike(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])") for w in words
    ]
    return reduce(Column.__add__, [h.cast("int") for h in hits])


def keyword_search(
    posts: DataFrame, query: str, attributes: list[str], where: Column | None = None, k: int = 5, key: str = "doc_id"
) -> DataFrame:
    """Posts by the number of query words per attribute; earlier attributes weigh more."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not words:
        return posts.withColumn("match_score", F.lit(0)).where(F.lit(False))
    weights = range(len(attributes), 0, -1)
    score = reduce(Column.__add__, [matched_words(F.col(a), words) * F.lit(w) for a, w in zip(attributes, weights)])
    filtered = posts if where is None else posts.where(where)
    scored = filtered.withColumn("match_score", score)
    # Posts without a match sort last, so the cut comes first and the score is computed once.
    return scored.orderBy(F.col("match_score").desc(), F.col(key).asc()).limit(k).where(F.col("match_score") > 0)


def search_recent(posts: DataFrame, query: str, attributes: list[str], created: str, k: int = 5, key: str = "doc_id") -> DataFrame:
    """The k best matches, newest first: the cut comes before the sort."""
    return keyword_search(posts, query, attributes, k=k, key=key).orderBy(F.col(created).desc(), F.col(key).asc())
