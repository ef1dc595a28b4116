"""URL verdicts by rules and, where none fits, by a tree of path templates per host, in DataFrame functions only.

1. A path is cut into segments, and runs of digits and long hexadecimal names in them become signs. Pages are counted by
   host and such a shape before anything else, so that a hot host is a few rows from then on.
2. In the tree of a host a branch that holds less than one in ``RARE`` pages below a parent with more than ``MANY``
   branches is variable, and becomes a wildcard.
3. Templates that differ in their last segment only are siblings. A sibling whose share of blocked labels does not differ
   from that of the others (two-proportion test) is merged with them.
4. A template's purity is its share of allowed labels, smoothed by that of its host, which is smoothed by that of all.
   Purity below one half is rejected; a host without any label is let through.

Labels come from a column, or else from the rules: what a rule allows or blocks teaches the rest of its host.

Defined results: null urls and those without :// have an empty host and path, which are a host and a path like others;
without any label everything is allowed; repeated rows count and come out as often as they go in; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): a rule fits the host and its subdomains if the path begins with the rule's; the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
RARE = 100
MANY = 8
#: Square of the normal quantile for 95 %.
Z2 = 3.84
#: Labels that a prior weighs as much as.
PRIOR = 4.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path)."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; equally long rules go by their text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the last one wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path with runs of digits as # and hexadecimal names of 8 or more as ~, without slashes at its end."""
    plain = F.regexp_replace(path, "/+$", "")
    return F.regexp_replace(F.regexp_replace(plain, "(^|/)[0-9a-f]*[0-9][0-9a-f]{7,}(?=/|$)", "$1~"), "[0-9]+", "#")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) from (host, shape, n): rare branches under a broad parent become *."""
    parts = F.split("shape", "/")
    branch = shapes.select("host", "shape", "n", F.posexplode(parts).alias("depth", "name")).withColumn(
        "parent", F.array_join(F.slice(F.split("shape", "/"), F.lit(1), F.col("depth")), "/")
    )
    counts = branch.groupBy("host", "depth", "parent", "name").agg(F.sum("n").alias("m"))
    parents = counts.groupBy("host", "depth", "parent").agg(F.sum("m").alias("total"), F.count("*").alias("branches"))
    rare = counts.join(parents, ["host", "depth", "parent"]).filter((F.col("branches") > MANY) & (F.col("m") * RARE < F.col("total")))
    tokens = branch.join(rare.select("host", "depth", "parent", "name", F.lit("*").alias("star")), ["host", "depth", "parent", "name"], "left")
    listed = tokens.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("star", "name").alias("token")))).alias("t"))
    return listed.select("host", "shape", F.array_join(F.col("t.token"), "/").alias("template"))


def merge_branches(stats: DataFrame) -> DataFrame:
    """(host, template, branch) from (host, template, good, bad): siblings with like shares of bad labels become one."""
    each = stats.withColumn("parent", F.regexp_replace("template", "[^/]*$", ""))
    family = each.groupBy("host", "parent").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("siblings"))
    n1, n2 = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
    b1, b2 = F.col("bad"), F.col("all_bad") - F.col("bad")
    gap = (b1 * n2 - b2 * n1).cast("double")
    spread = n1.cast("double") * n2.cast("double") * F.col("all_bad").cast("double") * F.col("all_good").cast("double")
    differs = (spread > 0) & (gap * gap * (n1 + n2).cast("double") > Z2 * spread)
    alone = (F.col("siblings") == 1) | differs
    return each.join(family, ["host", "parent"]).select("host", "template", F.when(alone, F.col("template")).otherwise(F.concat("parent", F.lit("*"))).alias("branch"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", label: str | None = None, rules=RULES) -> DataFrame:
    """Per page: key, host, path, rule, verdict, template. ``label``: a column of 'allow', 'block' or null to learn from."""
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"), (F.col(label) if label else F.lit(None).cast("string")).alias("_label"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("_key", "host", "path", rule.alias("rule"), said.alias("_said"), (F.col("_label") if label else said).alias("_label"), shape(F.col("path")).alias("shape"))
    one = lambda what: F.sum(F.when(F.col("_label") == what, 1).otherwise(0)).alias({"allow": "good", "block": "bad"}[what])
    shapes = base.groupBy("host", "shape").agg(F.count("*").alias("n"), one("allow"), one("block"))

    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    named = shapes.join(templates(shapes), ["host", "shape"])
    stats = named.groupBy("host", "template").agg(*sums)
    merged = stats.join(merge_branches(stats), ["host", "template"])
    branches = merged.groupBy("host", "branch").agg(*sums)
    hosts = shapes.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    all_good, all_bad = shapes.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = all_good / (all_good + all_bad) if all_good + all_bad else 1.0
    smoothed = lambda good, bad, prior: (F.col(good) + PRIOR * prior) / (F.col(good) + F.col(bad) + PRIOR)
    purity = smoothed("good", "bad", smoothed("host_good", "host_bad", F.lit(overall)))
    decided = branches.join(hosts, "host").select("host", "branch", F.when((purity < 0.5) & (F.col("host_good") + F.col("host_bad") > 0), "block").otherwise("allow").alias("learned"))
    verdicts = named.join(merged.select("host", "template", "branch"), ["host", "template"]).join(decided, ["host", "branch"]).select("host", "shape", "branch", "learned")
    out = base.join(verdicts, ["host", "shape"], "left")
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_said", "learned").alias("verdict"), F.col("branch").alias("template"))


ORACLE = r"""
WITH base AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(path, '/+$', ''), '/'),
      lambda s: CASE WHEN regexp_full_match(s, '[0-9a-f]*[0-9][0-9a-f]{7,}') THEN '~' ELSE s END), 'string_agg', '/'), '[0-9]+', '#', 'g') AS shape
  FROM base
),
said AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label FROM ruled
),
shapes AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (label = 'allow') AS good, count(*) FILTER (label = 'block') AS bad FROM said GROUP BY ALL
),
branch AS (
  SELECT host, shape, n, i AS depth, string_split(shape, '/')[i] AS name, array_to_string(string_split(shape, '/')[1:i - 1], '/') AS parent
  FROM (SELECT *, unnest(range(1, len(string_split(shape, '/')) + 1)) AS i FROM shapes)
),
counts AS (SELECT host, depth, parent, name, sum(n) AS m FROM branch GROUP BY ALL),
rare AS (
  SELECT host, depth, parent, name FROM (
    SELECT *, sum(m) OVER w AS total, count(*) OVER w AS branches FROM counts WINDOW w AS (PARTITION BY host, depth, parent))
  WHERE branches > 8 AND m * 100 < total
),
named AS (
  SELECT b.host, b.shape, string_agg(CASE WHEN r.name IS NULL THEN b.name ELSE '*' END, '/' ORDER BY b.depth) AS template
  FROM branch b LEFT JOIN rare r ON b.host = r.host AND b.depth = r.depth AND b.parent = r.parent AND b.name = r.name GROUP BY ALL
),
stats AS (
  SELECT host, template, sum(good) AS good, sum(bad) AS bad, regexp_replace(template, '[^/]*$', '') AS parent FROM shapes JOIN named USING (host, shape) GROUP BY ALL
),
family AS (
  SELECT *, sum(good) OVER w AS all_good, sum(bad) OVER w AS all_bad, count(*) OVER w AS siblings FROM stats WINDOW w AS (PARTITION BY host, parent)
),
tested AS (SELECT *, good + bad AS n1, all_good + all_bad - good - bad AS n2, bad AS b1, all_bad - bad AS b2 FROM family),
merged AS (
  SELECT host, template, good, bad, CASE WHEN siblings = 1 OR (CAST(n1 AS DOUBLE) * n2 * all_bad * all_good > 0
      AND CAST(b1 * n2 - b2 * n1 AS DOUBLE) * CAST(b1 * n2 - b2 * n1 AS DOUBLE) * CAST(n1 + n2 AS DOUBLE) > 3.84 * (CAST(n1 AS DOUBLE) * n2 * all_bad * all_good))
    THEN template ELSE parent || '*' END AS branch
  FROM tested
),
branches AS (SELECT host, branch, sum(good) AS good, sum(bad) AS bad FROM merged GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(good) + sum(bad) > 0 THEN CAST(sum(good) AS DOUBLE) / (sum(good) + sum(bad)) ELSE 1.0 END AS o FROM shapes),
hosts AS (SELECT host, (sum(good) + 4.0::DOUBLE * (SELECT o FROM overall)) / (sum(good) + sum(bad) + 4.0::DOUBLE) AS prior, sum(good) + sum(bad) AS known FROM shapes GROUP BY host),
decided AS (
  SELECT host, branch, CASE WHEN known > 0 AND (good + 4.0::DOUBLE * prior) / (good + bad + 4.0::DOUBLE) < 0.5 THEN 'block' ELSE 'allow' END AS learned FROM branches JOIN hosts USING (host)
)
SELECT page_id, host, path, rule, coalesce(label, learned) AS verdict, branch AS template
FROM said JOIN named USING (host, shape) JOIN merged USING (host, template) JOIN decided USING (host, branch)
"""
