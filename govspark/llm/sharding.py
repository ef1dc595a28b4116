"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash walks through the shard counts at which a key would have moved; the last jump below ``n`` is its shard. Nothing is
stored: key and count decide, and with one more shard a key either stays or goes to the new shard. Spark's own integer
product fails on overflow, so the generator's 64-bit product is put together from smaller ones.

Slots number the rows of a shard from 0 without gaps. A shard of any size is numbered in ``SUBSHARDS`` parts by hash of
the key; their sizes come from a count that reads the key column only, so no task holds a whole shard.

Defined results: a null text has size 1 and the check sum of no bytes; a null key is a key of its own; repeated rows are
numbered one after another in one shard; other columns pass through, those named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm.tables import BROADCAST_IDS, spare

#: Parts of a shard that are numbered apart; their sizes, shards * SUBSHARDS rows, are the only thing broadcast.
SUBSHARDS = 512
#: Fixed value: the multiplier of the published generator, key * M + 1 modulo 2^64, as halves.
M_HIGH, M_LOW = 0x27BB2EE6, 0x87B0B0FD
_LOW32 = 0xFFFFFFFF
#: Jumps tried at first; log(n) are expected. The few keys that need more go on until they are done.
FIRST_STEPS = 24


def _product32(x: Column, m: int) -> Column:
    """x * m modulo 2^32 for x below 2^32."""
    return (x * F.lit(m & 0xFFFF) + F.shiftleft((x * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW32))


def _step(state: Column, shards: int) -> Column:
    b, j, high, low = (state[name] for name in ("b", "j", "high", "low"))
    t0, t1 = low * F.lit(M_LOW & 0xFFFF), low * F.lit(M_LOW >> 16)
    bottom = t0.bitwiseAND(F.lit(_LOW32)) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(bottom, 32)
    top = F.shiftright(t0, 32) + F.shiftright(t1, 16) + carry + _product32(low, M_HIGH) + _product32(high, M_LOW)
    top, bottom = top.bitwiseAND(F.lit(_LOW32)), bottom.bitwiseAND(F.lit(_LOW32))
    draw = F.lit(float(1 << 31)) / (F.shiftright(top, 1) + F.lit(1)).cast("double")
    moved = F.struct(j.alias("b"), F.floor((j + F.lit(1)).cast("double") * draw).cast("long").alias("j"), top.alias("high"), bottom.alias("low"), F.when(j < shards, j).otherwise(state["last"]).alias("last"))
    return F.when(j <= shards, moved).otherwise(state)


def jump(key: Column, shards: int) -> Column:
    """A struct: ``last`` is the shard of a 64-bit key among ``shards``, ``b`` its shard among one more."""
    zero = F.lit(0).cast("long")
    state = F.struct(
        F.lit(-1).cast("long").alias("b"), zero.alias("j"), F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_LOW32)).alias("low"), zero.alias("last")
    )
    walk = lambda start, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: _step(acc, shards))
    first = walk(state, min(FIRST_STEPS, shards + 1))
    return first if shards < FIRST_STEPS else F.when(first["j"] > shards, first).otherwise(walk(first, shards + 1))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 42) -> DataFrame:
    """All columns but the text, and size, text_crc32, law, shard, slot, grown_shard (the shard with one more shard)."""
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    to, sub, at, start = spare(docs, "_to", "_part", "_at", "_start")
    placed = docs.withColumn(to, jump(hashed, shards)).withColumn(sub, F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(SUBSHARDS)).cast("int"))
    body = F.coalesce(F.col(text), F.lit(""))
    results = {
        "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary")), "law": F.lit("key"),
        "shard": F.col(f"{to}.last").cast("int"), "grown_shard": F.col(f"{to}.b").cast("int"),
    }
    kept = [c for c in docs.columns if c != text and c.lower() not in (*results, "slot")]
    rows = placed.select(*kept, *(c.alias(name) for name, c in results.items()), sub)
    before = Window.partitionBy("shard").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.select(F.col(f"{to}.last").cast("int").alias("shard"), sub).groupBy("shard", sub).count()
    starts = sizes.select("shard", sub, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    # at most shards * SUBSHARDS rows
    starts = F.broadcast(starts) if shards * SUBSHARDS <= BROADCAST_IDS else starts
    numbered = rows.withColumn(at, F.row_number().over(Window.partitionBy("shard", sub).orderBy(F.col(key), "text_crc32", "size")))
    numbered = numbered.join(starts, ["shard", sub]).withColumn("slot", F.col(start) + F.col(at) - 1)
    return numbered.select(*kept, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files_per_shard: int = 8, seed: int = 42) -> None:
    """All columns as Parquet in one folder per shard; a shard is written by several tasks."""
    to = docs.withColumn("shard", jump(F.xxhash64(F.col(key), F.lit(seed)), shards)["last"].cast("int"))
    part = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(files_per_shard))
    to.repartition(shards * files_per_shard, "shard", part).write.partitionBy("shard").mode("overwrite").parquet(path)
