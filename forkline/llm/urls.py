"""Block and allow rules for URLs: host suffixes and path prefixes joined on short hashes.

A rule names a host and the start of a path; it fits that host and all its subdomains. A URL
is expanded into the suffixes of its host, each with the starts of its path that end in a
slash (and the empty one). A rule has exactly one such expression: its host with its path up
to the last slash. Expressions meet by the first 32 bits of their SHA-256; the whole digest
and the rest of the rule's path are compared afterwards, so no rule is missed and none fits
by chance. The longest fitting rule decides, among equally long ones ``block``.

Each distinct URL is judged once, so a URL that fills the table costs one expansion, and
rules reach the pages by an equi-join on the URL. Expansion stops at the depth of the
deepest rule, beyond which none can fit.

Nulls: a null URL, or one without ``://``, has an empty host and path and fits no rule.
Rules with a null host, path or verdict are ignored; of repeated rules one counts. Repeated pages are judged alike.
An empty rule table leaves every page with the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import ascii_lower, keep_table, packed

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
PREFIX = 8  # hexadecimal digits


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)  # empty where there is none
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _folder(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "[.]"))


def _digested(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat("of_host", F.lit("\n"), "of_folder"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX))


def expand(urls: DataFrame, labels: int, depth: int) -> DataFrame:
    """Every host suffix of at most ``labels`` labels with every path start of at most ``depth`` slashes."""
    parts = F.split("host", "[.]")
    size = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(labels))), lambda n: F.array_join(F.slice(parts, size - n + 1, n), "."))
    pieces = F.split("path", "/")
    starts = F.transform(F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(depth))), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/"))))
    by_host = urls.withColumn("of_host", F.explode(suffixes))
    return _digested(by_host.withColumn("of_folder", F.explode(starts)))


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with all their columns in ``row``, and host, path, rule, verdict."""
    known = rules.dropna(subset=["host", "path", "verdict"]).select(ascii_lower(F.col("host")).alias("of_host"), F.col("path").alias("of_path"), "verdict")
    known = known.groupBy("of_host", "of_path").agg(F.max("verdict").alias("verdict"))  # of the two, block
    known = keep_table(pages.sparkSession, _digested(known.withColumn("of_folder", _folder(F.col("of_path")))), "url-rules")
    reach = known.agg(F.max(_labels(F.col("of_host"))).alias("labels"), F.max(_depth(F.col("of_folder"))).alias("depth")).first()
    host, path = url_parts(F.col(url))
    rows = packed(pages, F.col(url).alias("url"))
    urls = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path")).filter("host <> ''")
    expressions = expand(urls, reach["labels"] or 0, reach["depth"] or 0) if reach["labels"] else None
    empty = F.lit(None).cast("string")
    if expressions is None:
        judged = rows.withColumn("rule", empty).withColumn("found", empty)
    else:
        e, r = expressions.alias("e"), known.alias("r")
        same = (F.col("e.short") == F.col("r.short")) & (F.col("e.digest") == F.col("r.digest")) & F.startswith("e.path", "r.of_path")
        rule = F.concat("r.of_host", "r.of_path")
        best = F.max(F.struct(F.length(rule).alias("length"), F.col("r.verdict").alias("found"), rule.alias("rule"))).alias("best")
        fitting = e.join(r, same).groupBy(F.col("e.url").alias("of_url")).agg(best)
        judged = rows.join(fitting, F.col("url") == F.col("of_url"), "left").select("row", "url", "best.rule", "best.found")
    return judged.select("row", host.alias("host"), path.alias("path"), "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark)).select("row.page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), fits AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM hosts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""
