"""Scans, sinks and document parsing on data derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.functions import documents as d
from govspark.functions import text as t
from govspark.operators import chunk, flatten, vector
from govspark.operators.joins import new_records
from govspark.operators.spread import spread_scan
from govspark.scratch import run_dir
from govspark.sources import scans, sinks
from govspark.sources.tables import proposals, table, votes
from govspark.suite.registry import query

EVENT_ITEM = "struct<event_id:bigint,user_id:bigint,value:double>"


def event_files(spark, sf):
    path = run_dir(spark, "envelopes")
    items = table(spark, sf, "events").select(F.col("event_type").alias("network"), "event_id", "user_id", "value")
    sinks.write_envelopes(items, path, "network", ["event_id"])
    return path


@query("scan_json_envelope", "SELECT event_type AS network, event_id, user_id, value FROM events")
def scan_json_envelope(spark, sf):
    return scans.scan_envelopes(spark, event_files(spark, sf), EVENT_ITEM, multi_line=False)


@query("scan_file_report", "SELECT event_type AS network, COUNT(*) AS items, CAST(0 AS BIGINT) AS damaged, TRUE AS success FROM events GROUP BY 1")
def scan_file_report(spark, sf):
    """Files are named by chance, so the report is added up by the network whose folder they lie in."""
    report = scans.file_report(spark, event_files(spark, sf), EVENT_ITEM, multi_line=False)
    network = F.regexp_extract("file", "file_network=([^/]+)/", 1).alias("network")
    return report.groupBy(network).agg(F.sum("items").alias("items"), F.sum("damaged").alias("damaged"), F.every("success").alias("success"))


@query("sink_json_batched", """
SELECT event_type AS network, CAST(ceil(COUNT(*) / 1000.0) AS BIGINT) AS envelopes, COUNT(*) AS items FROM events GROUP BY 1""")
def sink_json_batched(spark, sf):
    written = spark.read.schema("network string, total_items int").json(event_files(spark, sf))
    return written.groupBy("network").agg(F.count(F.lit(1)).alias("envelopes"), F.sum("total_items").alias("items"))


@query("scan_json_list_or_object", """
SELECT event_id AS id, 1 AS part FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 2 FROM events WHERE event_type NOT IN ('click', 'error')""")
def scan_json_list_or_object(spark, sf):
    path, kind = run_dir(spark, "json-lines"), F.col("event_type")
    one = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit(1).alias("part")))
    two = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit(2).alias("part")))
    line = F.when(kind == "click", one).when(kind == "error", F.lit("{broken")).otherwise(
        F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    found = scans.scan_list_or_object(spark, path, whole_files=False)
    return found.select(flatten.path_value(F.col("element"), "id", "bigint").alias("id"),
                        flatten.path_value(F.col("element"), "part", "int").alias("part"))


VOTE_ITEM = ["parent_vote_id", "proposal_index", "voter", "lock_period"]


@query("scan_votes", """
SELECT l_orderkey AS parent_vote_id, l_partkey AS proposal_index, l_suppkey AS voter, l_linenumber - 1 AS lock_period,
       l_linenumber - 1 > 2 AS locked, '{"lock":' || (l_linenumber - 1) || '}' AS details FROM lineitem""")
def scan_votes(spark, sf):
    path = run_dir(spark, "votes")
    details = F.struct(F.col("lock_period").alias("lock")).alias("details")
    packed = sinks.envelopes(votes(spark, sf).select("decision", *VOTE_ITEM, details), "decision", VOTE_ITEM)
    bare = F.to_json("items")
    text = F.when(F.col("network") == "A", bare).otherwise(F.concat(F.lit('{"items":'), bare, F.lit("}")))
    packed.select(text.alias("value")).write.text(path)
    record = F.col("element")
    found = scans.scan_votes(spark, path, whole_files=False)
    lock = flatten.path_value(record, "details.lock", "int")
    return found.select(
        *[flatten.path_value(record, c, "bigint").alias(c) for c in VOTE_ITEM[:3]],
        flatten.path_value(record, "lock_period", "int").alias("lock_period"), (lock > 2).alias("locked"),
        F.to_json(F.try_variant_get(record, "$.details", "variant")).alias("details"),
    )


@query("scan_csv_roundtrip", "SELECT * FROM customer")
def scan_csv_roundtrip(spark, sf):
    customers, path = table(spark, sf, "customer"), run_dir(spark, "csv")
    sinks.write_csv(customers, path)
    return scans.scan_csv(spark, path, customers.schema)


@query("scan_csv_texts", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE ' "' || text || chr(10) || '\\' END AS text, source FROM documents""")
def scan_csv_texts(spark, sf):
    path = run_dir(spark, "csv-texts")
    key = F.col("doc_id")
    odd = F.when(key % 7 == 0, None).when(key % 11 == 0, "").otherwise(F.concat(F.lit(' "'), "text", F.lit("\n\\")))
    documents = table(spark, sf, "documents").select("doc_id", odd.alias("text"), "source")
    sinks.write_csv(documents, path)
    return scans.scan_csv(spark, path, documents.schema)


@query("sink_key_list", "SELECT event_id, event_type FROM events WHERE event_id % 2 = 1")
def sink_key_list(spark, sf):
    """The keys of records that were not known before, as a file."""
    path = run_dir(spark, "keys")
    events = table(spark, sf, "events")
    fresh = new_records(events, events.where("event_id % 2 = 0"), "event_id")
    sinks.write_key_list(fresh, path, ["event_id", "event_type"])
    return spark.read.schema("event_id bigint, event_type string").json(path)


@query("partition_pruned_scan", """
SELECT o_orderkey AS proposal_index, o_orderstatus AS status, o_orderpriority AS proposal_type FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'""")
def partition_pruned_scan(spark, sf):
    path = run_dir(spark, "partitioned")
    sinks.write_partitioned(proposals(spark, sf), path, ["status", "proposal_type"])
    found = spark.read.parquet(path).where((F.col("status") == "F") & (F.col("proposal_type") == "2-HIGH"))
    return found.select("proposal_index", "status", "proposal_type")


@query("vector_table_write", """
SELECT source AS collection, COUNT(*) AS documents, CAST(SUM(length(regexp_replace(text, '\\s', '', 'g'))) AS BIGINT) AS letters, TRUE AS distinct_ids, 256 AS dim
FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY source""")
def vector_table_write(spark, sf):
    """Whole texts: recursive chunks, vectors, one stored collection per source."""
    path = run_dir(spark, "vectors")
    chunks = chunk.chunk_recursive(spread_scan(table(spark, sf, "documents")), size=200, overlap=0).withColumnRenamed("source", "collection")
    sinks.write_vectors(vector.hash_embeddings(chunks), path)
    letters = F.sum(F.length(F.regexp_replace("content", r"\s", ""))).alias("letters")
    return spark.read.parquet(path).groupBy("collection").agg(
        F.countDistinct("doc_id").alias("documents"), letters, (F.countDistinct("chunk_id") == F.count(F.lit(1))).alias("distinct_ids"), F.max(F.size("embedding")).alias("dim"))


HEADED_SQL = """
headed AS (
  SELECT doc_id, CASE lang
    WHEN 'en' THEN 'Title: T' || doc_id || chr(10) || 'URL: https://example.org/' || doc_id || chr(10) || 'Type: page' || chr(10) ||
                   'Description: about ' || source || chr(10) || chr(10) || '==========' || chr(10) || text
    WHEN 'de' THEN 'Title: T' || doc_id || chr(10) || 'URL: https://example.org/' || doc_id || chr(10) || 'Description: about ' || source ||
                   chr(10) || chr(10) || text
    WHEN 'fr' THEN 'URL: https://example.org/' || doc_id || chr(10) || 'Title: T' || doc_id || chr(10) || '---' || chr(10) || text
    ELSE text END AS text FROM documents),
split AS (SELECT doc_id, string_split(text, chr(10)) AS r FROM headed)
"""
B = "' ' || chr(9) || chr(10) || chr(13)"


def headed(spark, sf):
    lang, key, about = F.col("lang"), F.col("doc_id").cast("string"), F.concat(F.lit("Description: about "), "source")
    title, url = F.concat(F.lit("Title: T"), key), F.concat(F.lit("URL: https://example.org/"), key)
    text = (
        F.when(lang == "en", F.concat_ws("\n", title, url, F.lit("Type: page"), about, F.lit(""), F.lit("=========="), "text"))
        .when(lang == "de", F.concat_ws("\n", title, url, about, F.lit(""), "text"))
        .when(lang == "fr", F.concat_ws("\n", url, title, F.lit("---"), "text"))
        .otherwise(F.col("text"))
    )
    return spread_scan(table(spark, sf, "documents")).select("doc_id", "source", text.alias("text"))


def _sql_value(line: str, mark: str) -> str:
    return f"trim(replace({line}, '{mark}', ''), {B})"


@query("parse_text_header", f"""
WITH {HEADED_SQL}, marked AS (
  SELECT *, list_position(list_transform(r, lambda x: contains(x, '=======')), true) AS sep,
         list_position(list_transform(r, lambda x: trim(x, {B}) = ''), true) AS blank FROM split)
SELECT doc_id, CASE WHEN starts_with(r[1], 'Title: ') THEN {_sql_value('r[1]', 'Title: ')} END AS title,
  CASE WHEN starts_with(r[2], 'URL: ') THEN {_sql_value('r[2]', 'URL: ')} END AS url,
  CASE WHEN starts_with(r[3], 'Type: ') THEN {_sql_value('r[3]', 'Type: ')} END AS type,
  CASE WHEN starts_with(r[3], 'Description: ') THEN {_sql_value('r[3]', 'Description: ')}
       WHEN starts_with(r[3], 'Type: ') AND starts_with(r[4], 'Description: ') THEN {_sql_value('r[4]', 'Description: ')} END AS description,
  trim(array_to_string(r[COALESCE(NULLIF(sep, 0), blank, 0) + 1:], chr(10)), {B}) AS content FROM marked""")
def parse_text_header(spark, sf):
    return headed(spark, sf).select("doc_id", d.fixed_header(F.col("text")).alias("h")).select("doc_id", "h.*")


@query("parse_text_header_v2", f"""
WITH {HEADED_SQL}, head AS (
  SELECT *, r[1:10] AS h, COALESCE(list_position(list_transform(r[1:10], lambda x: trim(x, {B}) IN ('', '---')), true), 0) AS stop FROM split),
scanned AS (SELECT *, CASE WHEN stop > 0 THEN h[1:stop - 1] ELSE h END AS s FROM head),
found AS (SELECT *, list_filter(s, lambda x: starts_with(x, 'Title: '))[-1] AS t, list_filter(s, lambda x: starts_with(x, 'URL: '))[-1] AS u,
  list_filter(s, lambda x: starts_with(x, 'Type: '))[-1] AS k, list_filter(s, lambda x: starts_with(x, 'Description: '))[-1] AS de,
  COALESCE(list_max(list_transform(s, lambda x, i: CASE WHEN regexp_matches(x, '^(Title|URL|Type|Description): ') THEN i ELSE 0 END)), 0) AS last FROM scanned)
SELECT doc_id, COALESCE({_sql_value('t', 'Title: ')}, 'doc' || doc_id) AS title, {_sql_value('u', 'URL: ')} AS url, {_sql_value('k', 'Type: ')} AS type,
  {_sql_value('de', 'Description: ')} AS description,
  trim(array_to_string(r[CASE WHEN stop > 0 THEN stop ELSE last END + 1:], chr(10)), {B}) AS content FROM found""")
def parse_text_header_v2(spark, sf):
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return headed(spark, sf).select("doc_id", d.free_header(F.col("text"), stem).alias("h")).select("doc_id", "h.*")


@query("json_doc_to_content", """
SELECT doc_id, 'Title: ' || source || chr(10) || chr(10) || 'Description: ' || lang || chr(10) || chr(10) ||
  CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END || 'Related Topics:' || chr(10) ||
  (SELECT string_agg('- ' || lang || ' ' || i || chr(10), '' ORDER BY i) FROM range(1, 11) t(i)) AS content,
  source AS title, '' AS url, 'unknown' AS content_type FROM documents""")
def json_doc_to_content(spark, sf):
    topics = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(F.concat_ws(" ", "lang", i.cast("string")).alias("title")))
    doc = F.struct(F.col("source").alias("title"), F.col("lang").alias("description"), F.col("text").alias("content"), topics.alias("topics"))
    raw = spread_scan(table(spark, sf, "documents")).select("doc_id", F.to_json(doc).alias("json"))
    return raw.select("doc_id", d.json_document(F.col("json")).alias("d")).select("doc_id", "d.*")


@query("source_precedence", """
SELECT source AS folder, doc_id AS stem, 'txt' AS extension FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT source, doc_id, 'json' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def source_precedence(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("stem"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("stem"))
    texts = docs.join(labelled, "stem", "left_semi").select("folder", "stem", F.lit("txt").alias("extension"))
    return d.text_before_json(texts.unionByName(docs.withColumn("extension", F.lit("json"))))


@query("onchain_to_document", """
WITH items AS (SELECT o_orderkey AS index, CASE o_orderpriority WHEN '1-URGENT' THEN 'Polkadot_a.json' WHEN '2-HIGH' THEN 'kusama_b.json'
    WHEN '3-MEDIUM' THEN 'kusama_c.json' ELSE 'summary.json' END AS file,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'Order ' || o_orderkey END AS title,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS content,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(o_custkey AS VARCHAR) END AS proposer,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS status FROM orders)
SELECT index, CASE WHEN file LIKE 'P%' THEN 'polkadot' ELSE 'kusama' END AS network,
  CASE WHEN title IS NULL THEN content ELSE 'Title: ' || title || CASE WHEN content <> '' THEN chr(10) || chr(10) || content ELSE '' END ||
    chr(10) || chr(10) || chr(10) || 'On-chain Information:' || chr(10) || chr(10) || 'Proposer: ' || proposer ||
    CASE WHEN status IS NOT NULL THEN chr(10) || chr(10) || 'Status: ' || status ELSE '' END END AS content
FROM items WHERE file <> 'summary.json' AND (title IS NOT NULL OR content <> '')""")
def onchain_to_document(spark, sf):
    kind, status = F.col("proposal_type"), F.col("status")
    items = proposals(spark, sf).select(
        F.col("proposal_index").alias("index"),
        F.when(kind == "1-URGENT", "Polkadot_a.json").when(kind == "2-HIGH", "kusama_b.json")
        .when(kind == "3-MEDIUM", "kusama_c.json").otherwise("summary.json").alias("file"),
        F.when(kind != "3-MEDIUM", F.concat_ws(" ", F.lit("Order"), "proposal_index")).alias("title"),
        F.when(status == "F", kind).otherwise("").alias("content"),
        F.when(kind != "3-MEDIUM", F.col("proposer").cast("string")).alias("proposer"),
        F.when(kind == "1-URGENT", status).alias("status"),
        F.lit(None).cast("string").alias("hash"),
    )
    return d.proposal_documents(items, "file").select("index", "network", "content")


COMBINE_CHARS = 50_000


@query("combine_by_group", f"""
WITH pieces AS (SELECT source, doc_id, chr(10) || chr(10) || '--- FILE: doc' || doc_id || ' ---' || chr(10) || text AS piece FROM documents
                WHERE trim(text, {B}) <> ''),
placed AS (SELECT *, SUM(length(piece) + 1) OVER (PARTITION BY source ORDER BY doc_id) - length(piece) - 1 AS start FROM pieces)
SELECT source, CAST(start // {COMBINE_CHARS} AS BIGINT) AS part, string_agg(piece, chr(10) ORDER BY doc_id) AS content, COUNT(*) AS file_count
FROM placed GROUP BY 1, 2""")
def combine_by_group(spark, sf):
    files = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return d.combine_by_group(files, "source", "doc_id", "title", "text", COMBINE_CHARS)


PIECES_SQL = f"SELECT *, chr(10) || chr(10) || '--- FILE: doc' || doc_id || ' ---' || chr(10) || text AS piece FROM documents WHERE trim(text, {B}) <> ''"


@query("combine_pieces", f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, piece FROM ({PIECES_SQL})")
def combine_pieces(spark, sf):
    files = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return d.combined_pieces(files, "doc_id", "title", "text", "source")


@query("combine_all", f"SELECT row_number() OVER (ORDER BY doc_id) AS position, piece FROM ({PIECES_SQL})")
def combine_all(spark, sf):
    files = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return d.combined_pieces(files, "doc_id", "title", "text")


def nested(spark, sf):
    """Events as nested JSON records."""
    extra = F.when(F.col("event_type") == "purchase", F.array(F.col("user_id"), F.col("event_id")))
    record = F.struct(
        F.col("event_type").alias("kind"),
        F.struct(
            F.struct(F.col("value").alias("Amount Paid")).alias("totals"),
            F.array(F.struct(F.col("user_id").alias("id")), F.struct((F.col("user_id") + 1).alias("id"))).alias("beneficiaries"),
        ).alias("onChainInfo"),
        F.from_json("props", "k bigint").alias("props"),
        extra.alias("tags"),
    )
    return spread_scan(table(spark, sf, "events")).select("event_id", F.to_json(record).alias("record"))


@query("flatten_wide", """
SELECT event_id, event_type AS kind, value AS onchaininfo_totals_amount_paid, user_id AS onchaininfo_beneficiaries_0_id,
  user_id + 1 AS onchaininfo_beneficiaries_1_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k,
  CASE WHEN event_type = 'purchase' THEN user_id END AS tags_0, CASE WHEN event_type = 'purchase' THEN event_id END AS tags_1 FROM events""")
def flatten_wide(spark, sf):
    parsed = flatten.parse_records(nested(spark, sf), "record").select("event_id", "record.*")
    flat = flatten.flatten_wide(parsed)
    return flat.withColumn("onchaininfo_totals_amount_paid", F.col("onchaininfo_totals_amount_paid").cast("double"))


@query("flatten_long", """
SELECT event_id, unnest(['kind', 'onchaininfo_totals_amount_paid', 'onchaininfo_beneficiaries_0_id', 'onchaininfo_beneficiaries_1_id', 'props_k']) AS path,
  unnest([event_type, CAST(value AS VARCHAR), CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR), CAST(json_extract(props, '$.k') AS VARCHAR)]) AS value FROM events
UNION ALL SELECT event_id, unnest(['tags_0', 'tags_1']), unnest([CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)]) FROM events WHERE event_type = 'purchase'""")
def flatten_long(spark, sf):
    flat = flatten.flatten_long(nested(spark, sf), "event_id", "record")
    number = F.when(F.col("path").like("%amount_paid"), F.col("value").cast("double").cast("string")).otherwise(F.col("value"))
    return flat.select("event_id", "path", number.alias("value"))


@query("json_text_leaves", r"""
WITH leaves AS (
  SELECT doc_id, '[title]: ' || source || ' in ' || lang || ' text' AS extract, source || ' in ' || lang || ' text' AS leaf FROM documents
  UNION ALL SELECT doc_id, line, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
trimmed AS (SELECT *, trim(leaf, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM leaves)
SELECT doc_id, extract FROM trimmed
WHERE length(b) BETWEEN 10 AND 5000 AND NOT regexp_matches(b, '^[0-9\-\s.,:;]+$') AND len(regexp_extract_all(b, '\S+')) >= 3
  AND NOT starts_with(b, 'http') AND len(list_distinct(string_split(replace(b, ' ', ''), ''))) >= 5""")
def json_text_leaves(spark, sf):
    record = F.struct(
        F.concat_ws(" ", "source", F.lit("in"), "lang", F.lit("text")).alias("title"), t.lines(F.col("text")).alias("lines"))
    docs = spread_scan(table(spark, sf, "documents")).select("doc_id", F.to_json(record).alias("record"))
    return flatten.text_leaves(docs, "doc_id", "record").select("doc_id", "extract")
