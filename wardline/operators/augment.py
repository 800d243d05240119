"""Pseudo-interactions: gates, per-user quotas, injection into the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gated(predictions: DataFrame, least_p1: float, least_margin: float) -> DataFrame:
    return predictions.where((F.col("psg_pred") == 1) & (F.col("p1") >= least_p1) & (F.col("margin") >= least_margin))


def quota(n, rho: float):
    """max(1, round(rho * n)), half to even."""
    return F.greatest(F.lit(1), F.bround(n * rho)).cast("long")


def inject(train: DataFrame, accepted: DataFrame, rho: float, most: int = 0) -> DataFrame:
    """u, i, source: all training pairs, and each training user's first new accepted pairs by (p1, margin, rank) up to the quota."""
    n = train.groupBy("u").agg(F.count("*").alias("n"))
    fresh = accepted.join(train.select("u", "i").distinct(), ["u", "i"], "left_anti").join(n, "u")
    best = fresh.groupBy("u", "i", "n").agg(F.max(F.struct(F.col("p1"), F.col("margin"), (-F.col("rank")).alias("r"))).alias("x"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("x"), "i"))
    limit = quota(F.col("n"), rho)
    limit = F.least(limit, F.lit(most)) if most else limit
    new = best.withColumn("_n", place).where(F.col("_n") <= limit)
    return train.select("u", "i", F.lit("observed").alias("source")).unionByName(new.select("u", "i", F.lit("pseudo").alias("source")))


def generated_ids(texts: DataFrame, items: DataFrame, train: DataFrame, most: int, least: int = 2) -> DataFrame:
    """u, i, place: catalogue items named as i<digits> in generated text, in order of first mention, unseen, at most ``most``; users with fewer than ``least`` valid ones get none."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z])i(\d{1,18})"), F.lit(1)))
    rows = texts.select("u", F.posexplode(ids).alias("pos", "id")).select("u", "pos", F.col("id").cast("long").alias("i"))
    rows = rows.groupBy("u", "i").agg(F.min("pos").alias("pos")).join(items.select("i"), "i", "left_semi")
    valid = F.count("*").over(Window.partitionBy("u"))
    rows = rows.withColumn("_v", valid).where(F.col("_v") >= least).join(train.select("u", "i"), ["u", "i"], "left_anti")
    w = Window.partitionBy("u").orderBy("pos")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("u", "i", "place")
