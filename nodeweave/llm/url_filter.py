"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter only lets pass what may be listed; the join removes its false positives. Its broadcast side has FILTER_BLOCKS
rows at most, however long the list is; a fuller filter passes more rows to the join and changes no verdict.

Defined cases: a null url, or one without ://, has empty host and path, fits no rule, and is listed nowhere: allow;
repeated rows are judged each on its own; repeated or null list entries count once or not; empty tables give empty ones;
of equally long rules that fit, the last by text wins; very long urls are urls like others; extra columns pass through,
those named like a result column (in letters of either case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import split_by, with_groups, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path) of the query's rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_path(url: str) -> tuple[Column, Column]:
    """Of the column `url`, which has no nulls."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    bare = F.regexp_extract(after, r"^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(bare, r"^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(bare, r"^[^/]*((?s:.*))$", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., path without trailing slashes; scheme, query and fragment are gone already. Null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


MADE = ("host", "path", "canonical", "rule", "verdict")


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """row (a struct of the columns of pages that aren't MADE here), host, path and canonical."""
    own = [c for c in pages.columns if c.lower() not in MADE]
    host, path = host_path("u")
    rows = pages.select(F.struct(*own).alias("row"), F.coalesce(F.col(url), F.lit("")).alias("u")).select("row", host.alias("host"), path.alias("path"))
    return rows.withColumn("canonical", canonical(F.col("host"), F.col("path")))


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows with rule and its verdict: the longest rule whose host is the host or a parent, and whose path begins the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rows.withColumns({"rule": rule, "verdict": verdict})


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, canonical, rule and verdict. listed: canonical URLs to block, in a column `canonical`."""
    rows = ruled(parsed(pages), rules)
    counted = listed.where(F.col("canonical").isNotNull()).groupBy("canonical").agg(F.lit(True).alias("listed"))
    free, maybe = split_by(rows.where(F.col("verdict").isNull()), counted, "canonical")
    hits = written(maybe, "hits")  # a hot url is dealt out: it has one row in the list
    sizes = hits.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).join(counted, "canonical")
    exact = with_groups(hits, sizes, "canonical", "n", hits.count()).withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    out = rows.where(F.col("verdict").isNotNull()).unionByName(free.withColumn("verdict", F.lit("allow"))).unionByName(exact.select(*rows.columns))
    return out.select("row.*", *MADE)


def op8(spark, sf_dir: str) -> DataFrame:
    """Listed, in place of an outside block list: the canonical URLs of the pages whose id is divisible by 100."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = parsed(pages.where("page_id % 100 = 0"))
    return url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE8 = r"""
WITH a AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END, '') AS u FROM pages),
b AS (SELECT page_id, regexp_extract(u, '^([^?#]*)', 1) AS u FROM a),
c AS (SELECT page_id, translate(regexp_extract(u, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(u, '/') THEN substring(u, instr(u, '/')) ELSE '' END AS path FROM b),
d AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM c),
e AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN canonical IN (SELECT canonical FROM d WHERE page_id % 100 = 0 AND canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM e"""
