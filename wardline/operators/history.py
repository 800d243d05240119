"""Interaction histories: duplicate removal, ranks, temporal splits, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_pairs(rows: DataFrame) -> DataFrame:
    """u, i, ts, rating: one row per pair with its last time and highest rating (partial sums before the shuffle)."""
    return rows.groupBy("u", "i").agg(F.max("ts").alias("ts"), F.max("rating").alias("rating"))


def keep_last(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys and value of the last row by order for each key; a plain aggregate, so a hot key is no single task."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_x")).select(*keys, F.col(f"_x.{value}").alias(value))


def ranked(rows: DataFrame) -> DataFrame:
    """history_rank (1 first), history_len, reverse_rank (1 last) per user by (ts, i)."""
    w = Window.partitionBy("u").orderBy("ts", "i")
    n = F.count("*").over(Window.partitionBy("u"))
    rows = rows.withColumns({"history_rank": F.row_number().over(w).cast("long"), "history_len": n})
    return rows.withColumn("reverse_rank", F.col("history_len") - F.col("history_rank") + 1)


def last_k(rows: DataFrame, k: int) -> DataFrame:
    """The k latest rows of each user."""
    w = Window.partitionBy("u").orderBy(F.desc("ts"), F.desc("i"))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)


def leave_last_two(rows: DataFrame, least: int = 3) -> DataFrame:
    """rows with split: the last of a user is test, the one before valid, the rest train; users with fewer rows go."""
    back = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("ts"), F.desc("i")))
    n = F.count("*").over(Window.partitionBy("u"))
    out = rows.withColumns({"back": back, "n": n}).where(F.col("n") >= least)
    return out.withColumn("split", F.when(F.col("back") == 1, "test").when(F.col("back") == 2, "valid").otherwise("train")).drop("n")


def last_and_rest(rows: DataFrame, least: int = 3) -> DataFrame:
    """u, i, rest: of rows of one per pair each user's test item under leave_last_two, and the list of all others; users with fewer rows go. No history is sorted."""
    lists = rows.groupBy("u").agg(F.max(F.struct("ts", "i")).alias("last"), F.collect_list("i").alias("all"), F.count("*").alias("n")).where(F.col("n") >= least)
    return lists.select("u", F.col("last.i").alias("i"), F.coalesce(F.array_remove("all", F.col("last.i")), "all").alias("rest"))


def valid_and_train(rows: DataFrame, least: int = 3) -> DataFrame:
    """u, i, train: of rows of one per pair each user's valid item under leave_last_two, and the list of the training items; users with fewer rows go."""
    lists = rows.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("ts", "i")), False).alias("x")).where(F.size("x") >= least)
    ids = F.col("x.i")
    return lists.select("u", ids[1].alias("i"), F.array_compact(F.slice(ids, F.lit(3), F.size("x"))).alias("train"))


def eligible(counts: DataFrame, least: int, most: int = 0, positives: int = 0) -> DataFrame:
    """Users with total in [least, most] (most 0: no cap) and at least so many positives."""
    out = counts.where((F.col("total") >= least) & (F.col("positives") >= positives))
    return out.where(F.col("total") <= most) if most else out


def sequence_rows(split: DataFrame) -> DataFrame:
    """u, i, pos: 0-based place in train, then valid, then test."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    w = Window.partitionBy("u").orderBy(order, "ts", "i")
    return split.select("u", "i", "split", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def top_values(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, value, n, rank: the k most frequent values of each key, ties in value order."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def capped(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k latest rows of each combination of keys, with place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("i"))
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def until_last(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Rows no later than the last row of the user's profile."""
    last = profile.groupBy("u").agg(F.max("ts").alias("_last"))
    return rows.join(last, "u").where(F.col("ts") <= F.col("_last")).drop("_last")


def described(rows: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and greatest of a column, on one row."""
    x = F.col(value).cast("double")
    quartile = lambda p: F.round(F.percentile(x, F.lit(p)), digits)
    return rows.agg(
        F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), F.round(F.stddev(x), digits).alias("std"), F.min(x).alias("least"),
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max(x).alias("greatest"),
    )
