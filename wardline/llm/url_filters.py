"""Operator 2, URL filters by hashed host suffixes and path prefixes; DataFrame operations only.

Each distinct (host, path) is expanded into host suffixes and path prefixes,
at the label counts and path lengths that the rules have. The expressions'
SHA-256 digests meet the rules' digests on their first 32 bits, full digests
confirm, and of the rules that fit the longest wins (then the longer host,
then block). The verdicts go back to the pages by (host, path).

Rules are (host, path, action) rows. They are broadcast if at most
BROADCAST_RULES; beyond that the join shuffles on the hash prefix.

Defined results: a null URL or one without :// has empty host and path and is
allowed; repeated rows each get a row; URLs may have any length (only the label
counts and path lengths of rules are expanded); of rules of one length the longer
host wins, then block (ties); other columns of pages are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
DEFAULT = "allow"
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", F.regexp_extract(F.coalesce(rest, F.lit("")), "(?s)^[^?#]*", 0).alias("bare"))
    rows = rows.select("page_id", "bare", F.regexp_extract("bare", "(?s)^[^/]*", 0).alias("raw"))
    return rows.select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), F.expr("substring(bare, length(raw) + 1)").alias("path"))


def digest(host, path) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(full) -> Column:
    return F.substring(full, 1, 8)


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (host and path, or null), verdict."""
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").where("rule_host is not null and rule_path is not null")
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", "\\."))).alias("n"), F.collect_set(F.length("rule_path")).alias("m"), F.count("*").alias("c")).first()
    full = digest(F.col("rule_host"), F.col("rule_path"))
    known = rules.select(full.alias("full"), "rule_host", "rule_path", "action")
    known = known.groupBy("full").agg(F.max(F.struct("rule_host", "rule_path", "action")).alias("r")).select("full", short(F.col("full")).alias("short"), "r.*")
    if shape["c"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    rows = split_urls(pages)
    each = rows.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    counts = F.filter(F.array(*[F.lit(n) for n in sorted(shape["n"])]).cast("array<int>"), lambda n: n <= F.size(labels))
    lengths = F.filter(F.array(*[F.lit(m) for m in sorted(shape["m"])]).cast("array<int>"), lambda m: m <= F.length("path"))
    grown = each.select("host", "path", F.explode(F.transform(counts, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))).alias("suffix"))
    grown = grown.select("host", "path", "suffix", F.explode(F.transform(lengths, lambda m: F.substring("path", F.lit(1), m))).alias("prefix"))
    grown = grown.withColumn("own", digest(F.col("suffix"), F.col("prefix")))
    fits = grown.join(known, short(F.col("own")) == F.col("short")).where("own = full")
    size = F.length("rule_host") + F.length("rule_path")
    best = F.max(F.struct(size.alias("size"), F.length("rule_host").alias("host_size"), F.col("action"), F.concat("rule_host", F.col("rule_path")).alias("rule")))
    won = fits.groupBy("host", "path").agg(best.alias("best"))
    out = rows.join(won, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(DEFAULT)).alias("verdict"))
