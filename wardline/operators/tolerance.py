"""Percentile tolerances of users with population defaults and minor caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.policy import DIMS

#: The most a minor tolerates per dimension.
MINOR_CAPS = {"is_adult": 0, "sex": 2, "violence": 3, "profanity": 3, "drug": 2, "intense": 3}


def tolerances(history: DataFrame, users: DataFrame, least: int = 5, q: float = 0.75) -> DataFrame:
    """u, is_minor, train_history_count, used_population_default, tol_raw_* and tol_*: the ceiling of the exact q-percentile of each code.

    history: u and the codes of each item. Users with fewer rows take the
    percentile over all rows of their age group.
    """
    names = ["is_adult", *DIMS]
    rows = history.withColumn("is_adult", F.col("is_adult").cast("int")).join(users.select("u", "is_minor"), "u")
    top = lambda d: F.ceil(F.percentile(d, F.lit(q)))
    group = rows.groupBy("is_minor").agg(*[top(d).alias(f"all_{d}") for d in names])
    own = rows.groupBy("u").agg(F.count("*").alias("n"), *[top(d).alias(f"own_{d}") for d in names])
    out = users.select("u", "is_minor").join(own, "u", "left").join(F.broadcast(group), "is_minor", "left")
    n = F.coalesce("n", F.lit(0))
    raw = {d: F.when(n >= least, F.col(f"own_{d}")).otherwise(F.col(f"all_{d}")).cast("long") for d in names}
    out = out.select("u", "is_minor", n.cast("long").alias("train_history_count"), (n < least).cast("int").alias("used_population_default"), *[raw[d].alias(f"tol_raw_{d}") for d in names])
    return out.select("*", *[F.when(F.col("is_minor"), F.least(F.col(f"tol_raw_{d}"), F.lit(MINOR_CAPS[d]))).otherwise(F.col(f"tol_raw_{d}")).cast("long").alias(f"tol_{d}") for d in names])
