"""URL filtering by host and path rules, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict) of the contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RULE_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each part of it after a dot: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def path_prefixes(path: Column, lengths: Sequence[int]) -> Column:
    """The path's first characters, at each length that a rule's path has."""
    return F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())


def digest(host: Column, path: Column) -> Column:
    # A host has no slash and a path begins with one or is empty, so the two can't be confused.
    return F.sha2(F.concat(host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix: int = 8) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url; others are ignored).

    rules: host, path, verdict; hosts in lower case. A rule fits its host and all subdomains where
    the path begins with the rule's; the longest fitting rule wins (host and path together, then
    the longer host, then block before allow). Each URL expands to host suffixes and path
    prefixes; these join rules on `prefix` hex digits of the digest and are confirmed by all of it.
    Null and odd urls have an empty host and path and fit no rule; repeated rows stay; a rule with
    a null is ignored; no rules: all get the default.
    """
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna().distinct()
    # The distinct lengths of rule paths: a few numbers, however many rules there are.
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect()) or [0]
    known = known.withColumn("full", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, prefix))
    parted = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # URLs with equal host and first path characters are judged once, so a hot host is one row.
    heads = parted.select("host", F.substring("path", 1, lengths[-1]).alias("head")).distinct().where("host <> ''")
    expressions = heads.select("host", "head", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    expressions = expressions.select("host", "head", "suffix", F.explode(path_prefixes(F.col("head"), lengths)).alias("start"))
    expressions = expressions.withColumn("own", digest(F.col("suffix"), F.col("start"))).withColumn("short", F.substring("own", 1, prefix))
    fits = expressions.join(known, "short").where("own = full AND suffix = rule_host AND start = rule_path")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("rule_verdict") == "block"), "rule_host", "rule_path")
    best = fits.groupBy("host", "head").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), order).alias("best"))
    best = best.select(F.col("host").alias("best_host"), F.col("head").alias("best_head"), "best.rule", "best.rule_verdict")
    same = (F.col("host") == F.col("best_host")) & (F.substring("path", 1, lengths[-1]) == F.col("best_head"))
    return parted.join(best, same, "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = """
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT DISTINCT host, path, h, p, v FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM fit GROUP BY host, path)
SELECT cut.page_id, cut.host, cut.path, best.rule, coalesce(best.v, 'allow') AS verdict FROM cut LEFT JOIN best USING (host, path)
"""
