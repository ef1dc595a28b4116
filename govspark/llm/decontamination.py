"""Benchmark decontamination by a positional inverted index of the documents, in DataFrame functions only.

Each benchmark item is cut into phrases of ``width`` words. The corpus frequency of every benchmark term is counted, and
each phrase is looked up by its rarest term, its anchor. The index stores one posting per occurrence of an anchor:
term, document, position, and the words around it as far as a phrase can reach. A posting list moved by the anchor's
offset gives the places where the phrase would begin; there the words of the other terms are compared, so a match is
exact. Proximity matches compare the same lists with a tolerance. Frequent terms get no postings unless a phrase has no
rarer one, and the text is never shuffled. Every document has one more posting, under the empty term, with its size.

The terms and phrases of the benchmark go to every task only while their counted number is within a limit; a larger
benchmark is joined by shuffle.

Defined results: a null or blank text has no words, an item without words has no phrase and is never found; items with
equal words are all found; repeated rows of a document come out as often as they go in; items that share an item_id
count as one. Columns beyond key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm.tables import plain_docs
from govspark.scratch import settle

WIDTH = 10
#: Benchmark terms or phrases (about 200 bytes each) that may travel to every task.
BROADCAST_ROWS = 200_000
#: Above all keys.
FIRST_UNNAMED = "9223372036854775808"
#: What separates words, and the letters that are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrases(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, phrase, terms): all runs of ``width`` words of an item; a shorter item is one phrase."""
    items = benchmark.select(F.col(key).alias("item"), words(F.col(text)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))
    runs = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("terms"))
    return runs.select("item", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the documents of the given distinct terms; terms that do not occur are left out."""
    found = docs.select(F.explode(words(F.col("body"))).alias("term")).join(_bounded(terms), "term")
    return found.groupBy("term").agg(F.count("*").alias("n"))


def anchors(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, terms, term, offset): each phrase all of whose terms occur, with its rarest term."""
    distinct = found.select("phrase", "terms").dropDuplicates(["phrase"])
    each = distinct.select("phrase", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    best = each.groupBy("phrase").agg(
        F.min_by(F.struct("term", "offset", "terms"), F.struct("n", "offset")).alias("best"), F.count("n").alias("known"), F.count("*").alias("all")
    )
    return best.filter("known = all").select("phrase", "best.terms", "best.term", "best.offset")


def build_index(docs: DataFrame, anchor_terms: DataFrame, reach: int) -> DataFrame:
    """(term, doc, pos, before, around, n_words): the postings of the anchor terms, and one under '' per document.

    ``around`` are up to ``reach`` words on either side with the term itself, ``before`` of them in front of it.
    """
    listed = anchor_terms.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    tokens = docs.select("doc", words(F.col("body")).alias("all"))
    tokens = tokens.select("doc", "all", F.posexplode(F.concat(F.array(F.lit("")), F.col("all"))).alias("place", "term"))
    hits = tokens.join(_bounded(listed), "term").withColumn("pos", F.col("place") - 1)
    before = F.least("pos", F.lit(reach))
    real = F.col("term") != ""
    return hits.select(
        "term", "doc", "pos", F.when(real, before).alias("before"),
        F.when(real, F.slice("all", F.col("pos") - before + 1, before + reach + 1)).alias("around"),
        F.when(~real, F.size("all")).cast("long").alias("n_words"),
    )


def exact_matches(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc, phrase, start, length): every place where a phrase occurs."""
    moved = index.filter("term != ''").join(_bounded(anchored), "term").filter("before >= offset")
    same = F.slice("around", F.col("before") - F.col("offset") + 1, F.size("terms")) == F.col("terms")
    return moved.filter(same).select("doc", "phrase", (F.col("pos") - F.col("offset")).alias("start"), F.size("terms").alias("length"))


def proximity_matches(index: DataFrame, anchored: DataFrame, least: int, slack: int = 0) -> DataFrame:
    """(doc, phrase, start, common): places where at least ``least`` of a phrase's distinct terms, its rarest among them,
    stand within the phrase's reach widened by ``slack`` words on either side.

    The index must have been built with ``reach`` of the phrase's length plus ``slack`` to see that far.
    """
    moved = index.filter("term != ''").join(_bounded(anchored), "term")
    begin = F.greatest(F.lit(0), F.col("before") - F.col("offset") - slack)
    stop = F.col("before") - F.col("offset") + F.size("terms") + slack
    common = F.size(F.array_intersect(F.slice("around", begin + 1, stop - begin), "terms"))
    near = moved.select("doc", "phrase", (F.col("pos") - F.col("offset")).alias("start"), common.alias("common"))
    return near.filter(F.col("common") >= least)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH
) -> DataFrame:
    """Per document: key, n_words, n_hit (words inside any match), items (ids as sorted text), n_items."""
    # a row without a key gets a number beyond those of keys
    unnamed = F.lit(FIRST_UNNAMED).cast("decimal(20,0)") + F.monotonically_increasing_id().cast("decimal(19,0)")
    plain = plain_docs(docs, key, text).withColumn("doc", F.coalesce(F.col("doc").cast("decimal(20,0)"), unnamed.cast("decimal(20,0)")))
    found = settle(phrases(benchmark, item, item_text, width), "phrases")
    terms = settle(found.select(F.explode("terms").alias("term")).distinct(), "terms")
    anchored = settle(anchors(found, term_counts(plain, terms)), "anchors")
    index = settle(build_index(plain, anchored.select("term").distinct(), width - 1), "postings")
    matches = settle(exact_matches(index, anchored), "matches")

    places = matches.select("doc", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    earlier = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0))))
    hit = places.select("doc", covered.cast("long").alias("covered")).groupBy("doc").agg(F.sum("covered").alias("n_hit"))
    owners = matches.select("doc", "phrase").distinct().join(found.select("phrase", "item"), "phrase").select("doc", F.col("item").cast("string").alias("item"))
    items = owners.distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    sizes = index.filter("term = ''").select("doc", "n_words")
    joined = sizes.join(hit, "doc", "left").join(items, "doc", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.when(F.col("doc") < F.lit(FIRST_UNNAMED).cast("decimal(20,0)"), F.col("doc").cast("long")).alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")
    ).withColumn("n_items", F.size("items").cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose key has no match. No match can name a row without a key: it stays, whatever its text."""
    dirty = contamination(docs, benchmark, key, text, **how).filter("n_hit > 0").select(key).distinct()
    return docs.join(dirty, key, "left_anti")
