"""Row-level transforms on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.functions import amounts, coerce, keys, links
from govspark.functions import text as t
from govspark.operators import ordered, preview
from govspark.operators.spread import spread_scan
from govspark.sources.tables import proposals, table, votes
from govspark.suite.filters import TYPED_SQL, typed
from govspark.suite.governance import ASSET_SQL, with_assets
from govspark.suite.registry import query

SITE = "example.org"


@query("sanitize_key", """
SELECT part_key, trim(regexp_replace(lower(part_key), '[^0-9a-z]+', '_', 'g'), '_') AS clean
FROM (SELECT p_partkey, ' ' || p_name || '-' || p_brand || '!' AS part_key FROM part)""")
def sanitize_key(spark, sf):
    raw = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit("!")).alias("part_key"))
    return raw.withColumn("clean", keys.sanitize_key(F.col("part_key")))


@query("clean_column_name", """
WITH raw AS (SELECT CASE WHEN p_size > 25 THEN p_size || '.' || p_name ELSE p_brand || '--' || p_name END AS name FROM part),
cleaned AS (SELECT name, trim(regexp_replace(regexp_replace(name, '[ .-]', '_', 'g'), '_+', '_', 'g'), '_') AS clean FROM raw)
SELECT name, lower(CASE WHEN regexp_matches(clean, '^[0-9]') THEN 'col_' || clean ELSE clean END) AS clean FROM cleaned""")
def clean_column_name(spark, sf):
    raw = table(spark, sf, "part").select(
        F.when(F.col("p_size") > 25, F.concat_ws(".", "p_size", "p_name")).otherwise(F.concat_ws("--", "p_brand", "p_name")).alias("name")
    )
    return raw.withColumn("clean", keys.clean_column(F.col("name")))


@query("adjusted_balance", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber - 1 AS lock_period, CASE WHEN l_returnflag = 'N' THEN NULL
       ELSE l_extendedprice * CASE WHEN l_linenumber = 1 THEN 0.1::DOUBLE ELSE (l_linenumber - 1)::DOUBLE END END AS adjusted
FROM lineitem""")
def adjusted_balance(spark, sf):
    rows = table(spark, sf, "lineitem")
    balance = F.when(F.col("l_returnflag") == "N", F.lit("not a number")).otherwise(F.col("l_extendedprice").cast("string"))
    lock = (F.col("l_linenumber") - 1).alias("lock_period")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", lock,
        amounts.conviction_weighted(balance, (F.col("l_linenumber") - 1).cast("string")).alias("adjusted"),
    )


@query("composite_key", f"""
WITH {TYPED_SQL}
SELECT proposal_index, '_' || proposal_type || '_' || proposal_index || '_' || CASE WHEN status = 'Executed' THEN '' ELSE status END AS row_index
FROM typed""")
def composite_key(spark, sf):
    rows = typed(spark, sf).select(
        "proposal_index",
        F.col("proposal_type").alias("source_proposal_type"),
        F.col("proposal_index").alias("index"),
        F.when(F.col("status") != "Executed", F.col("status")).alias("onchaininfo_hash"),
    )
    return rows.select("proposal_index", keys.composite_key(rows, keys.RECORD_KEY).alias("row_index"))


FILES = {
    "click": "polkadot_ReferendumV2_20240101.csv",
    "view": "kusama_Bounty_20240101.csv",
    "error": "other_Tip.csv",
    "signup": "single.csv",
    "purchase": "polkadot_Discussion.csv",
}


@query("source_tracking", "WITH files AS (SELECT event_id, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in FILES.items()) + """ END AS source_file FROM events)
SELECT event_id, source_file,
       CASE WHEN source_file LIKE 'polkadot\\_%' ESCAPE '\\' THEN 'polkadot' WHEN source_file LIKE 'kusama\\_%' ESCAPE '\\' THEN 'kusama'
            ELSE 'unknown' END AS source_network,
       CASE WHEN len(string_split(replace(source_file, '.csv', ''), '_')) >= 2
            THEN string_split(replace(source_file, '.csv', ''), '_')[2] ELSE 'unknown' END AS source_proposal_type,
       row_number() OVER (PARTITION BY source_file ORDER BY event_id) AS source_row_id
FROM files""")
def source_tracking(spark, sf):
    file = F.when(F.lit(False), F.lit(""))
    for kind, name in FILES.items():
        file = file.when(F.col("event_type") == kind, F.lit(name))
    rows = table(spark, sf, "events").select("event_id", file.alias("source_file"))
    # Numbered first: the derived texts need not move with the rows.
    numbered = ordered.positions(rows, ["source_file"], ["event_id"], "source_row_id")
    return numbered.withColumn("source_network", links.file_network(F.col("source_file"))).withColumn(
        "source_proposal_type", links.file_proposal_type(F.col("source_file"))
    )


RAW_SQL = """
raw AS (
  SELECT event_id,
         CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN ' f ' WHEN 'signup' THEN '1' WHEN 'error' THEN 'NaN'
              ELSE 'maybe' END AS flag,
         CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '' WHEN 'signup' THEN ' -' || CAST(value AS VARCHAR)
              ELSE CAST(value AS VARCHAR) END AS amount,
         CASE event_type WHEN 'error' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment
  FROM events)
"""


def raw_events(spark, sf):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", "Yes").when(kind == "view", " f ").when(kind == "signup", "1").when(kind == "error", "NaN")
        .otherwise("maybe").alias("flag"),
        F.when(kind == "error", "n/a").when(kind == "view", "").when(kind == "signup", F.concat(F.lit(" -"), value))
        .otherwise(value).alias("amount"),
        F.when(kind == "error", "soon").otherwise(F.left(F.col("ts").cast("string"), F.lit(19))).alias("moment"),
    )


TYPED_RAW = """
  CASE WHEN lower(trim(flag)) IN ('true','1','yes','y','t') THEN TRUE WHEN lower(trim(flag)) IN ('false','0','no','n','f') THEN FALSE END"""


@query("coerce_types", f"""
WITH {RAW_SQL}
SELECT event_id, {TYPED_RAW} AS as_boolean, CAST(trunc(TRY_CAST(trim(amount) AS DECIMAL(38,6))) AS BIGINT) AS as_integer,
       TRY_CAST(trim(amount) AS DOUBLE) AS as_float, TRY_CAST(moment AS TIMESTAMP) AS as_timestamp,
       TRY_CAST(moment AS TIMESTAMP)::DATE AS as_date FROM raw""")
def coerce_types(spark, sf):
    return raw_events(spark, sf).select(
        "event_id",
        coerce.to_boolean(F.col("flag")).alias("as_boolean"),
        coerce.to_integer(F.col("amount")).cast("bigint").alias("as_integer"),
        coerce.to_float(F.col("amount")).alias("as_float"),
        coerce.to_timestamp(F.col("moment")).alias("as_timestamp"),
        coerce.to_date(F.col("moment")).alias("as_date"),
    )


@query("normalize_nulls", f"""
WITH {RAW_SQL}
SELECT event_id, CASE WHEN flag IN ('NaN','nan','null','NULL','') THEN NULL ELSE flag END AS flag,
       CASE WHEN amount IN ('NaN','nan','null','NULL','') THEN NULL ELSE amount END AS amount FROM raw""")
def normalize_nulls(spark, sf):
    rows = raw_events(spark, sf)
    return rows.select("event_id", *[coerce.normalize_null(F.col(c)).alias(c) for c in ("flag", "amount")])


@query("apply_schema", f"""
WITH {RAW_SQL}
SELECT event_id, {TYPED_RAW} AS flag, TRY_CAST(trim(amount) AS DOUBLE) AS amount, TRY_CAST(moment AS TIMESTAMP)::DATE AS moment FROM raw""")
def apply_schema(spark, sf):
    types = coerce.schema_types({"columns": {
        "flag": {"data_type": "bool"}, "amount": {"data_type": "float64"}, "moment": {"data_type": "Date"}}})
    return coerce.apply_schema(raw_events(spark, sf), types)


@query("format_amount", f"""
WITH {ASSET_SQL}, scaled AS (
  SELECT *, CASE WHEN asset_id IN (1984, 1337) THEN amount / 1e6 WHEN asset_id = 30 THEN amount / 1e3 ELSE amount END AS s,
         CASE WHEN asset_id = 1984 THEN ' USDT' WHEN asset_id = 1337 THEN ' USDC' WHEN asset_id = 30 THEN ' DED'
              WHEN asset_id IS NULL THEN ' DOT' ELSE ' (Asset ID: ' || asset_id || ')' END AS label FROM assets)
SELECT proposal_index, CASE WHEN NOT isnan(amount) THEN format('{{:,.2f}}', s) END AS amount_formatted,
       CASE WHEN NOT isnan(amount) THEN format('{{:,.2f}}', s) || label END AS amount_display FROM scaled""")
def format_amount(spark, sf):
    shown = amounts.with_display(with_assets(proposals(spark, sf)), "amount", "asset_id")
    return shown.select("proposal_index", "amount_formatted", "amount_display")


@query("proposal_link", f"""
WITH {TYPED_SQL}, given AS (
  SELECT proposal_index, CASE status WHEN 'Deciding' THEN NULL WHEN 'Executed' THEN 'Polkadot' WHEN 'Submitted' THEN 'kusama' ELSE 'other' END AS network,
         CASE WHEN proposal_type = 'Bounty' THEN NULL ELSE proposal_type END AS proposal_type,
         CASE WHEN amount > 250000 THEN 'Spend ' || proposal_index END AS title FROM typed),
named AS (SELECT *, COALESCE(lower(network), 'polkadot') AS n, COALESCE(proposal_type, 'ReferendumV2') AS k FROM given),
linked AS (SELECT *, CASE WHEN n IN ('polkadot','kusama') AND k IN ('ReferendumV2','Discussion')
           THEN 'https://' || n || '.{SITE}/' || CASE k WHEN 'Discussion' THEN 'post' ELSE 'referenda' END || '/' || proposal_index END AS link FROM named)
SELECT proposal_index, link AS proposal_link,
       '[' || COALESCE(title, 'Proposal ' || proposal_index) || '](' || link || ')' AS proposal_link_display FROM linked""")
def proposal_link(spark, sf):
    status, kind = F.col("status"), F.col("proposal_type")
    given = typed(spark, sf).select(
        "proposal_index",
        F.when(status == "Executed", "Polkadot").when(status == "Submitted", "kusama")
        .when(status == "DecisionDepositPlaced", "other").alias("network"),
        F.when(kind != "Bounty", kind).alias("proposal_type"),
        F.when(F.col("amount") > 250000, F.concat(F.lit("Spend "), "proposal_index")).alias("title"),
    )
    return links.with_proposal_link(given, SITE).select("proposal_index", "proposal_link", "proposal_link_display")


@query("scale_units", """
SELECT o_orderkey AS proposal_index, CAST(CAST(o_totalprice * 100 AS BIGINT) AS DOUBLE) / 100 AS whole_units FROM orders""")
def scale_units(spark, sf):
    base = F.round(F.col("amount") * 100).cast("decimal(38,0)") * F.lit(10**7).cast("decimal(10,0)")
    return proposals(spark, sf).select("proposal_index", amounts.remove_zeros(base).cast("double").alias("whole_units"))


@query("result_preview", """
WITH first AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents ORDER BY doc_id LIMIT 10)
SELECT CAST(n AS INTEGER) AS row_number, '#' || n || ': Doc Id: ' || doc_id || ', Text: ' ||
       CASE WHEN length(text) > 2000 THEN left(text, 2000) || '... [truncated]' ELSE text END ||
       ', Lang: ' || lang || ', Source: ' || source || ', N Chars: ' || n_chars AS line FROM first""")
def result_preview(spark, sf):
    return preview.result_preview(table(spark, sf, "documents"), [F.col("doc_id")])


@query("content_preview", """
SELECT doc_id, trim(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS preview,
       trim(CASE WHEN length(regexp_replace(text, '[#*]', '', 'g')) > 200 THEN left(regexp_replace(text, '[#*]', '', 'g'), 200) || '...'
            ELSE regexp_replace(text, '[#*]', '', 'g') END, ' ' || chr(9) || chr(10) || chr(13)) AS plain FROM documents""")
def content_preview(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", t.content_preview(text).alias("preview"), t.content_preview(text, keep_markdown=False).alias("plain")
    )


@query("format_epoch", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'Unknown date' WHEN 'view' THEN 'Unknown date'
  ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def format_epoch(spark, sf):
    kind = F.col("event_type")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    epoch = F.when(kind == "error", F.lit(0)).when(kind != "view", seconds)
    return table(spark, sf, "events").select("event_id", t.format_epoch(epoch).alias("shown"))


IMAGES = "\\n![ok](https://images.example.org/a.png)\\n![a](https://images.example.org/b.png) ![b](http://elsewhere.test/c.png)\\nend"


@query("clean_image_lines", """
SELECT doc_id, text || chr(10) || '![ok](https://images.example.org/a.png)' || chr(10) || 'end' AS cleaned FROM documents""")
def clean_image_lines(spark, sf):
    injected = F.concat("text", F.lit(IMAGES.replace("\\n", "\n")))
    return table(spark, sf, "documents").select("doc_id", t.keep_allowed_images(injected, "https://images.example.org").alias("cleaned"))


@query("strip_markup", "SELECT doc_id, replace(replace(text, '**', ''), '-', '') AS plain FROM documents")
def strip_markup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.strip_markup(F.col("text")).alias("plain"))


@query("markdown_issues")
def markdown_issues(spark, sf):
    found = spread_scan(table(spark, sf, "documents")).select("doc_id", F.inline(t.markdown_matches(F.col("text"))))
    return found.withColumn("samples", F.array_join("samples", " | "))


@query("extract_path", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k.missing') AS BIGINT) AS missing,
       '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS props_json FROM events""")
def extract_path(spark, sf):
    from govspark.operators.flatten import path_value

    parsed = F.try_parse_json(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id",
        path_value(parsed, "k", "bigint").alias("k"),
        path_value(parsed, "k.missing", "bigint").alias("missing"),
        F.to_json(parsed).alias("props_json"),
    )


@query("approx_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def approx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.approx_tokens(F.col("text")).alias("tokens"))


@query("vote_record", """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS index_voteraddress FROM lineitem""")
def vote_record(spark, sf):
    rows = votes(spark, sf)
    return rows.select(
        F.col("parent_vote_id").alias("l_orderkey"), F.col("proposal_index").alias("l_partkey"), F.col("voter").alias("l_suppkey"),
        keys.composite_key(rows, ["proposal_index", "voter"]).alias("index_voteraddress"),
    )
