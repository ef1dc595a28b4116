"""Envelope folders, loads and stored aggregates on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from govspark.operators import bitmaps, sketches
from govspark.scratch import run_dir
from govspark.sources import envelope_source, layout, quarantine, variants
from govspark.sources.tables import proposals, proposer_networks, table, votes, voting_power
from govspark.streaming import growing, memory, quota, standings
from govspark.streaming.sink import run_to_table
from govspark.suite.registry import ORACLES, query
from govspark.suite import voting  # noqa: F401  its queries have the twins used here
from govspark.suite.texts import RECALL_SQL, TRANSCRIPT_SQL, talk

EVENT_ITEMS = "network string, event_id long, user_id long, ts timestamp_ntz, value double, props string"


def event_envelopes(spark, sf):
    """A folder of envelopes, one network per event type."""
    envelope_source.register(spark)
    path = run_dir(spark, "envelopes")
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "network").select(*[c.split()[0] for c in EVENT_ITEMS.split(", ")])
    rows.write.format("envelopes").mode("append").option("path", path).save()
    return path


@query("envelope_source", """
SELECT event_type AS network, event_id, user_id, ts, value, props FROM events WHERE event_type IN ('purchase', 'click') AND value >= 5 AND user_id > 10""")
def envelope_source_query(spark, sf):
    read = spark.read.format("envelopes").schema(EVENT_ITEMS).option("path", event_envelopes(spark, sf))
    return read.load().where("network IN ('purchase', 'click') AND value >= 5 AND user_id > 10")


@query("envelope_stream", "SELECT event_type AS network, event_id, user_id, ts, value, props FROM events")
def envelope_stream(spark, sf):
    """Two commits, streamed from folder to folder; the second run of the stream takes the second commit only."""
    path, target, checkpoint = event_envelopes(spark, sf), run_dir(spark, "envelopes"), run_dir(spark, "checkpoint")
    read = spark.read.format("envelopes").schema(EVENT_ITEMS)
    later = read.option("path", path).load().where("event_id % 2 = 0")
    first = run_dir(spark, "envelopes")
    for rows in (later, read.option("path", path).load().where("event_id % 2 = 1")):
        rows.write.format("envelopes").mode("append").option("path", first).save()
        stream = spark.readStream.format("envelopes").schema(EVENT_ITEMS).option("path", first).load()
        run = stream.writeStream.format("envelopes").option("path", target).option("run", "copy").option("checkpointLocation", checkpoint).start()
        run.processAllAvailable()
        run.stop()
    return read.option("path", target).load()


def grown(spark, sf):
    """Events in three loads: with few fields, with more of them and some damaged lines, with users by name."""
    landing, target, checkpoint = (run_dir(spark, name) for name in ("landing", "target", "checkpoint"))
    events = table(spark, sf, "events")
    user, kind = F.col("user_id"), F.col("event_type").alias("kind")
    more = [kind, F.col("value"), F.from_json("props", "k bigint").alias("props")]
    waves = [
        F.to_json(F.struct("event_id", user.alias("user"), kind)),
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), "event_id")).otherwise(F.to_json(F.struct("event_id", user.alias("user"), *more))),
        F.to_json(F.struct("event_id", F.concat(F.lit("u"), user.cast("string")).alias("user"), *more)),
    ]
    for i, line in enumerate(waves):
        events.where(F.col("event_id") % 3 == i).select(line.alias("value")).write.mode("append").text(landing)
        rows = growing.growing_load(spark, landing, target, checkpoint, "event_id")
    return rows, target


@query("growing_load", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'u' ELSE '' END || user_id AS user_name, event_type AS kind,
  CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events WHERE NOT (event_id % 3 = 1 AND event_type = 'error')""")
def growing_load(spark, sf):
    rows, _ = grown(spark, sf)
    user = F.try_variant_get("user", "$", "string").alias("user_name")
    return rows.select("event_id", user, "kind", F.col("value").cast("double").alias("value"), F.col("props.k").alias("k"))


@query("growing_rejected", """SELECT '{"event_id": ' || event_id AS value FROM events WHERE event_id % 3 = 1 AND event_type = 'error'""")
def growing_rejected(spark, sf):
    return growing.rejected(spark, grown(spark, sf)[1]).select("value")


@query("bucketed_power", """
SELECT l_orderkey AS parent_vote_id, l_suppkey AS voter, l_partkey AS proposal_index, o_totalprice AS self_voting_power
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def bucketed_power(spark, sf):
    """Votes with their power, from tables that lie in the same buckets."""
    cast = votes(spark, sf).select("parent_vote_id", "voter", "proposal_index")
    power = voting_power(spark, sf).withColumnRenamed("id", "parent_vote_id")
    buckets = layout.buckets_for(cast.count(), 20_000)
    names = {}
    for name, rows in (("votes", cast), ("power", power)):
        path = run_dir(spark, f"bucketed-{name}")
        names[name] = (f"{name}_{uuid.uuid4().hex}", path)
        layout.write_bucketed(rows, *names[name], "parent_vote_id", buckets)
    return layout.bucketed_join(spark, *names["votes"], names["power"][0], "parent_vote_id", "left")


@query("clustered_proposals", """
WITH p AS (SELECT o_orderkey AS proposal_index, o_orderpriority AS proposal_type, o_orderstatus AS status, r_name AS network FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'network' AS asked, * FROM p WHERE network = 'ASIA' UNION ALL SELECT 'type', * FROM p WHERE proposal_type IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'both', * FROM p WHERE network = 'EUROPE' AND status = 'P'""")
def clustered_proposals(spark, sf):
    """Filters on one or more of the clustered columns; each opens the files it needs."""
    path = run_dir(spark, "clustered")
    rows = proposals(spark, sf).join(proposer_networks(spark, sf), "proposer").select("proposal_index", "proposal_type", "status", "network")
    layout.write_clustered(rows, path, ["network", "proposal_type", "status"], "proposal_index", file_rows=1000)
    asked = {"network": {"network": ["ASIA"]}, "type": {"proposal_type": ["1-URGENT", "5-LOW"]}, "both": {"network": ["EUROPE"], "status": ["P"]}}
    found = [layout.read_clustered(spark, path, where).select(F.lit(name).alias("asked"), "*") for name, where in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def remembered(spark, sf):
    """All conversations, streamed in two batches out of order."""
    stream = memory.conversation_states(memory.landed_messages(spark, talk(spark, sf), 2), parts=2)
    with quota.rocksdb(spark):
        return run_to_table(stream, "memory")


@query("history_stream", TRANSCRIPT_SQL)
def history_stream(spark, sf):
    return memory.current_transcripts(remembered(spark, sf))


@query("recall_stream", RECALL_SQL)
def recall_stream(spark, sf):
    return memory.current_memories(remembered(spark, sf))


DAMAGED_ITEM = "struct<event_id:bigint,value:double>"


def damaged_envelopes(spark, sf):
    """Envelopes per user: some items are texts, some have a text for a number, some lines end too early."""
    item = (
        F.when(F.col("event_id") % 50 == 0, F.lit('"lost"'))
        .when(F.col("event_id") % 50 == 1, F.concat(F.lit('{"event_id":"x'), "event_id", F.lit('"}')))
        .otherwise(F.to_json(F.struct("event_id", "value")))
    )
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))), lambda e: e["item"]), ",")
    per_user = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("network"), "user_id").agg(items.alias("items"))
    line = F.concat(F.lit('{"network":"'), "network", F.lit('","items":['), "items", F.when(F.col("user_id") % 20 == 7, "").otherwise("]}"))
    path = run_dir(spark, "damaged")
    per_user.select(line.alias("value")).repartition(3, "value").write.text(path)
    return path


def checked(spark, sf):
    return quarantine.load_checked(spark, damaged_envelopes(spark, sf), DAMAGED_ITEM, run_dir(spark, "checked"))


@query("quarantine_good", """
SELECT 'u' || user_id AS network, event_id, value FROM events WHERE user_id % 20 <> 7 AND event_id % 50 > 1""")
def quarantine_good(spark, sf):
    return checked(spark, sf).good.drop("file")


@query("quarantine_rejected", """
SELECT CASE WHEN user_id % 20 = 7 THEN 'no envelope' WHEN event_id % 50 = 0 THEN 'no object' ELSE 'wrong type' END AS reason,
  CASE WHEN user_id % 20 <> 7 THEN 'u' || user_id END AS network, COUNT(DISTINCT CASE WHEN user_id % 20 = 7 THEN user_id ELSE event_id END) AS pieces
FROM events WHERE user_id % 20 = 7 OR event_id % 50 <= 1 GROUP BY 1, 2""")
def quarantine_rejected(spark, sf):
    return checked(spark, sf).rejected.groupBy("reason", "network").agg(F.count("*").alias("pieces"))


PERIOD_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS kind, CAST(date_trunc('{p}', l_shipdate) AS DATE) AS period, COUNT(DISTINCT l_suppkey) AS voters FROM lineitem GROUP BY 2" for p in bitmaps.PERIODS
)


@query("distinct_voters_periods", PERIOD_SQL)
def distinct_voters_periods(spark, sf):
    """Voters of every month, quarter and year from the months' bitmaps, which come in three loads."""
    path = run_dir(spark, "bitmaps")
    for i in range(3):
        rows = votes(spark, sf).where(F.col("parent_vote_id") % 3 == i)
        bitmaps.store_month_bitmaps(rows, "voter", "created_at", path, f"load{i}")
    found = [bitmaps.distinct_by_period(spark, path, p).select(F.lit(p).alias("kind"), "period", F.col("distinct").alias("voters")) for p in bitmaps.PERIODS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("standings_top_voters", ORACLES["v_top_voters"])
def standings_top_voters(spark, sf):
    """After three loads, one of them twice, and a fold between them."""
    store = run_dir(spark, "standings")
    for i in (0, 1, 1, 2):
        rows = votes(spark, sf).where(F.col("proposal_index") % 3 == i)
        standings.add_load(rows, voting_power(spark, sf), store, f"load{i}")
        if i == 1:
            standings.fold(spark, store)
    return standings.top_voters(spark, store)


def sketched(spark, sf):
    """Sketches of orders by year, as if each had come in a file of its own, in two loads."""
    path = run_dir(spark, "sketches")
    orders = table(spark, sf, "orders")
    for i in range(2):
        sketches.add_files(orders.where(F.year("o_orderdate") % 2 == i), F.year("o_orderdate").cast("string"), path, f"load{i}")
    return path


@query("sketch_counts", """
WITH y AS (SELECT COUNT(DISTINCT year(o_orderdate)) AS files, COUNT(*) AS rows FROM orders)
SELECT 'o_totalprice' AS column_name, files, rows, CAST(min(o_totalprice) AS DOUBLE) AS least, CAST(max(o_totalprice) AS DOUBLE) AS greatest FROM orders, y GROUP BY files, rows
UNION ALL SELECT 'o_custkey', files, rows, CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM orders, y GROUP BY files, rows""")
def sketch_counts(spark, sf):
    """What merged sketches know exactly."""
    found = sketches.merged_profile(spark, sketched(spark, sf)).where("column_name IN ('o_totalprice', 'o_custkey')")
    return found.select("column_name", "files", "rows", F.col("least").cast("double").alias("least"), F.col("greatest").cast("double").alias("greatest"))


@query("sketch_profile")
def sketch_profile(spark, sf):
    """Estimates too; tests hold them against exact values."""
    return sketches.merged_profile(spark, sketched(spark, sf))


@query("variant_fields", """
SELECT event_id, user_id AS who_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, value AS amount,
  '{"id":' || user_id || '}' AS who FROM events WHERE event_type = 'purchase'""")
def variant_fields(spark, sf):
    """Dotted paths of stored records, read from the columns that hold them; one is nested and comes as JSON."""
    path = run_dir(spark, "variants")
    record = F.to_json(F.struct(F.struct(F.col("user_id").alias("id")).alias("who"), F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("props"), F.col("value").alias("amount")))
    variants.store_records(table(spark, sf, "events").select("event_id", record.alias("value")), path, keys=["event_id"])
    with variants.shredding(spark):
        stored = spark.read.parquet(path).where(variants.at("kind") == "purchase")
        return variants.fields(stored, {"who.id": "bigint", "kind": "string", "props.k": "bigint", "amount": "double", "who": "json"}, ["event_id"])
