"""Accuracy and exposure of ranked lists, per cutoff and audience group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def idcg(n: Column) -> Column:
    """Sum of 1 / log2(r + 1) over the first n ranks."""
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))


def per_user(ranked: DataFrame, positives: DataFrame, flags: list[str], ks=KS) -> DataFrame:
    """u, is_minor, k, hit, ndcg, slots and sums of flags: ranked has u, i, rank, is_minor and flags; ranked once for all cutoffs.

    Users without positives are not counted.
    """
    # a user's positives are one list, so that rows move once, by user, for the join and for the sums
    pos = positives.select("u", "i").groupBy("u").agg(F.collect_set("i").alias("pos"), (F.size(F.collect_set("i")) + F.max(F.col("i").isNull().cast("int"))).alias("n_pos"))
    rows = ranked.join(pos, "u").withColumn("is_pos", F.array_contains("pos", F.col("i")).cast("int")).drop("pos")
    rows = rows.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))))
    gain = F.when(F.col("is_pos") == 1, 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    out = rows.groupBy("u", "is_minor", "k", "n_pos").agg(F.max(F.coalesce("is_pos", F.lit(0))).alias("hit"), F.sum(gain).alias("dcg"), F.count("*").alias("slots"), *[F.sum(f).alias(f) for f in flags])
    return out.withColumn("ndcg", F.col("dcg") / idcg(F.least(F.col("n_pos"), F.col("k")).cast("int"))).drop("dcg", "n_pos")


def groups() -> Column:
    return F.explode(F.array(F.lit("all"), F.when(F.col("is_minor"), "minor").otherwise("adult"))).alias("grp")


def summarise(users: DataFrame, flags: list[str], digits: int = 6) -> DataFrame:
    """k, grp, users, hr, ndcg and micro exposure (flagged slots over returned slots) of all, minors and adults."""
    rows = users.select("*", groups())
    share = lambda f: F.round(F.sum(f) / F.sum("slots"), digits).alias(f)
    out = rows.groupBy(F.col("k").cast("long").alias("k"), "grp")
    return out.agg(F.count("*").alias("users"), F.round(F.avg("hit"), digits).alias("hr"), F.round(F.avg("ndcg"), digits).alias("ndcg"), *[share(f) for f in flags])


def macro(users: DataFrame, flag: str, digits: int = 6) -> DataFrame:
    """k, grp and the flag's exposure averaged over users: over k slots, and over the slots returned; mean length; share of full lists."""
    rows = users.select("*", groups())
    k, n = F.col("k"), F.col("slots")
    r = lambda x, name: F.round(F.avg(x), digits).alias(name)
    return rows.groupBy(k.cast("long").alias("k"), "grp").agg(r(F.col(flag) / k, "exposure_k"), r(F.col(flag) / n, "exposure_len"), r(n, "mean_length"), r((n == k).cast("int"), "full_list_fraction"))


def single_positive(positives: DataFrame, ranked: DataFrame, ks=KS, digits: int = 6) -> DataFrame:
    """k, n, hr, ndcg over rows (u, i) of one positive each; a positive outside the ranking counts as 0."""
    rows = positives.join(ranked.select("u", "i", "rank"), ["u", "i"], "left").withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    gain = F.when(hit, F.log(F.lit(2.0)) / F.log(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), digits).alias("hr"), F.round(F.avg(gain), digits).alias("ndcg"))
