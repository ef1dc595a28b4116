"""Exact near-duplicate classes by a blocked sparse product of the document by n-gram incidence with itself.

Two documents link when their sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100. The product
is taken over blocks of the incidence that size-derived bounds leave:

1. *Block by hash order.* Of ``n`` n-grams two linked documents share at least ``need(n)``. So among the first
   ``n - need(n) + slack(n)`` n-grams by hash they share ``slack`` ones; a document with fewer n-grams there that occur
   elsewhere has no partner and leaves. One shuffle of about a quarter of the incidence serves counts and join.
2. *Classes.* Equal sets become one row of the matrix; membership is kept aside.
3. *Block by rarity.* In the remaining rows, n-grams of one document only go, rows left with fewer than ``need(n)`` go,
   and of the others only the rarest ``usable - need(n) + 1`` columns are multiplied: what many documents share is
   multiplied last and so hardly ever.
4. *Product.* Of each column, first the smallest document is multiplied with the others (as many products as entries).
   Survivors form components. Then columns that still hold several components are multiplied across components only. A
   product is made only if either row has enough columns left, from the common one on, for the overlap that the two sizes
   ask for: this holds at the first column that a linked pair has in common. Pairs that remain get their whole overlap.

No link between different components is lost: linked documents share a column, and are either joined already or
multiplied there. Inside a component further products change nothing and are not made.

Defined results: upper-case A-Z is lowered; a text with fewer than ``width`` words is one n-gram of all of them; a null or
blank text has an empty set, links with nothing and is its own component. Repeated rows of a key come out as often as
they go in; a row without a key comes out with nulls. N-grams are compared by 64-bit hashes, sets by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.components import components
from govspark.llm.tables import broadcast_ids, plain_docs
from govspark.llm.words import HASHED_BYTES, map_texts, mix, parts, split_words, window_hashes
from govspark.scratch import settle

WIDTH = 5
PERCENT = 80
MIN_LONG = -(2**63)
#: Share of a set, in percent, that two linked documents must have in common in the block by hash order.
SLACK = 5


def need(n, percent: int):
    """Least overlap of a set of n with any set it links with; for columns and numpy arrays alike."""
    if isinstance(n, Column):
        return F.floor((n * percent + 99) / 100).cast("int")
    return (n * percent + 99) // 100


def _slack(n):
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.floor(n * SLACK / 100).cast("int"))
    return np.maximum(1, n * SLACK // 100)


def gram_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of all texts, ascending within each; where each text begins in them)."""
    words = split_words(texts, lower=True)
    hashes, sizes = words.hashes(), np.diff(words.first)
    grams, at = window_hashes(hashes, words.first, width)
    found, owners = [grams], [words.document()[at]]
    for short in range(1, width):
        which = np.flatnonzero(sizes == short)
        total = np.zeros(len(which), np.uint64)
        for i in range(short):
            total = mix(total + hashes[words.first[which] + i]) if len(which) else total
        found.append(mix(total + np.uint64(short)))
        owners.append(which)
    grams, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


_BLOCK = T.StructType([
    T.StructField("gram", T.LongType(), False), T.StructField("doc", T.LongType(), False),
    T.StructField("n", T.IntegerType(), False), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
])


def _hash_block(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The block by hash order, and one more row per document with its set's two digests, dealt out by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit=HASHED_BYTES):
                grams, first = gram_sets(part.column("body"), width)
                n = np.diff(first)
                doc = part.column("doc").to_numpy()
                a, b = _segment_sums(mix(grams), first), _segment_sums(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), first)
                inside = np.arange(len(grams)) - np.repeat(first[:-1], n)
                block = inside < np.repeat(n - need(n, percent) + _slack(n), n)
                owner = np.repeat(np.arange(len(n)), n)[block]
                lone = mix(doc.astype(np.uint64) ^ mix(a))
                blank = pa.nulls(len(owner), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([grams[block], lone]).view(np.int64)),
                        pa.array(np.concatenate([doc[owner], doc])),
                        pa.array(np.concatenate([n[owner], n]).astype(np.int32)),
                        *(pa.concat_arrays([blank, pa.array(x.view(np.int64))]) for x in (a, b)),
                    ],
                    schema=pa.schema([("gram", pa.int64(), False), ("doc", pa.int64(), False), ("n", pa.int32(), False), ("a", pa.int64()), ("b", pa.int64())]),
                )

    return map_texts(docs, run, _BLOCK)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, limit=HASHED_BYTES):
                grams, first = gram_sets(part.column("body"), width)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(first).astype(np.int32)), lists], names=["doc", "n", "grams"])

    return map_texts(docs, run, "doc long, n int, grams array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link, by their whole overlap."""
    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return both.filter(F.col("common") * 100 >= (F.size("ga") + F.size("gb") - F.col("common")) * percent).select("a", "b")


def _can_link(na: str, nb: str, rest_a: str, rest_b: str, percent: int) -> Column:
    """Whether two rows whose first common column leaves ``rest`` columns of each, itself included, can overlap enough.

    A similarity of p / 100 is an overlap of at least p / (100 + p) of both sizes together.
    """
    least = F.floor(((F.col(na) + F.col(nb)) * percent + 99 + percent) / (100 + percent))
    return F.least(rest_a, rest_b) >= least


def similarity_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable by links, itself included)."""
    plain = plain_docs(docs, key, text).filter("doc IS NOT NULL")
    block = _hash_block(plain, width, percent).repartition("gram")
    ends = block.groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *(F.max(c).alias(f"max_{c}") for c in ("n", "a", "b")))
    # the conditions on n, a and b say nothing, but keep both readers of ``block`` at the same columns, so that they share one shuffle
    same = F.col("max_n") >= 0
    for c in ("max_a", "max_b"):
        same = same & (F.col(c).isNull() | (F.col(c) >= MIN_LONG))
    several = ends.filter(same & (F.col("lo") < F.col("hi"))).select("gram", F.lit(1).alias("shared"))
    hits = block.join(several, "gram", "left").filter("shared IS NOT NULL OR a IS NOT NULL")
    found = settle(hits.groupBy("doc", "n").agg(F.count("shared").alias("hits"), F.max("a").alias("a"), F.max("b").alias("b")), "blocks")
    profiles = found.select("doc", "n", "a", "b")
    partners = found.filter(F.col("hits") >= _slack(need(F.col("n"), percent))).select("doc")

    # one row of the matrix for each distinct set that may have a partner
    classes = profiles.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc").alias("first"))
    rows = settle(partners.join(classes.select(F.col("first").alias("doc")), "doc", "left_semi").distinct(), "rows")
    sets = settle(_sets(plain.join(broadcast_ids(rows), "doc", "left_semi"), width).dropDuplicates(["doc"]), "sets")

    entries = sets.select("doc", "n", F.explode("grams").alias("gram"))
    counts = entries.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    of_doc = Window.partitionBy("doc")
    rare = entries.join(counts, "gram").select(
        "doc", "n", "gram",
        F.row_number().over(of_doc.orderBy("df", "gram")).alias("place"), F.count("*").over(of_doc).alias("usable"),
    )
    rare = rare.withColumn("rest", F.col("usable") - F.col("place") + 1).filter(F.col("rest") >= need(F.col("n"), percent))
    columns = settle(rare.select("doc", "n", "gram", "rest"), "columns")

    heads = columns.groupBy("gram").agg(F.min(F.struct("doc", "n", "rest")).alias("head"), F.count("*").alias("m")).filter("m > 1")
    stars = columns.join(heads, "gram").filter(F.col("head.doc") < F.col("doc"))
    stars = stars.filter(_can_link("head.n", "n", "head.rest", "rest", percent)).select(F.col("head.doc").alias("a"), F.col("doc").alias("b")).distinct()
    first_links = settle(_linked(stars, sets, percent), "links")

    placed = columns.join(components(first_links).withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    split = placed.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("gram")
    split = settle(placed.join(split, "gram", "left_semi").select("gram", "doc", "n", "rest", "c"), "split")
    groups = split.groupBy("gram", "c").agg(F.min("n").alias("nc"), F.max("rest").alias("rc"))
    others = groups.select("gram", F.col("c").alias("d"), F.col("nc").alias("nd"), F.col("rc").alias("rd"))
    across = groups.join(others, "gram").filter((F.col("c") < F.col("d")) & _can_link("nc", "nd", "rc", "rd", percent)).select("gram", "c", "d")
    left = split.select("gram", "c", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    right = split.select("gram", F.col("c").alias("d"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    products = across.join(left, ["gram", "c"]).join(right, ["gram", "d"]).filter(_can_link("na", "nb", "ra", "rb", percent))
    more_links = _linked(products.select("a", "b").distinct(), sets, percent)

    joined = components(first_links.unionByName(more_links)).withColumnRenamed("node", "first")
    member = profiles.join(classes, ["n", "a", "b"], "left").join(joined, "first", "left")
    member = member.select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "first", "doc").alias("component_id"))
    return docs.select(key).join(member.withColumnRenamed("doc", key), key, "left")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` but those whose key is not the smallest of its component. A row without a key is in no
    component and stays."""
    later = settle(similarity_components(docs, key, text, **how).filter(F.col(key) != F.col("component_id")).select(key).distinct(), "later")
    return docs.join(broadcast_ids(later), key, "left_anti")
