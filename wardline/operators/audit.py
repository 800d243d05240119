"""Consistency checks and summaries: each returns counts that should be zero, or plain statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_leaks(split: DataFrame) -> DataFrame:
    """check, n: pairs of two splits, and users whose times run backward between splits (should all be 0)."""
    sets = {s: split.where(F.col("split") == s).select("u", "i") for s in ("train", "valid", "test")}
    span = split.groupBy("u", "split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    out = []
    for a, b in (("train", "valid"), ("train", "test"), ("valid", "test")):
        out.append(sets[a].join(sets[b], ["u", "i"], "left_semi").agg(F.lit(f"{a}_{b}_overlap").alias("check"), F.count("*").alias("n")))
        early = span.where(F.col("split") == a).select("u", "hi").join(span.where(F.col("split") == b).select("u", F.col("lo").alias("next")), "u").where("hi > next")
        out.append(early.agg(F.lit(f"{a}_{b}_time").alias("check"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


def pool_leaks(split: DataFrame, pools: dict[str, DataFrame]) -> DataFrame:
    """check, n: users whose negatives hold own interactions of any split, and users whose pool heads are not their positives (should all be 0).

    pools: by split, the u, pos, place, i of the pool reader. A positive without a pool counts as a mismatch.
    """
    own = split.select("u", "i").distinct()
    out = []
    for name, pool in pools.items():
        hit = pool.where("place > 0").join(own, ["u", "i"], "left_semi")
        out.append(hit.agg(F.lit(f"{name}_negative_leak").alias("check"), F.count_distinct("u").alias("n")))
        heads = pool.select("u", F.col("pos").alias("i")).distinct()
        want = split.where(F.col("split") == name).select("u", "i").distinct()
        odd = heads.join(want, ["u", "i"], "left_anti").union(want.join(heads, ["u", "i"], "left_anti"))
        out.append(odd.agg(F.lit(f"{name}_head_mismatch").alias("check"), F.count_distinct("u").alias("n")))
    return reduce(DataFrame.unionByName, out)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """total, matched, coverage of rows whose key other has."""
    have = other.select(key).distinct().withColumn("_m", F.lit(1))
    return rows.join(have, key, "left").agg(F.count("*").alias("total"), F.count("_m").alias("matched"), F.round(F.count("_m") / F.count("*"), 6).alias("coverage"))


def exposure_faults(users: DataFrame, parts: list[str], whole: str) -> DataFrame:
    """check, n: rows where a part exceeds the whole, or the whole exceeds the slots (should be 0)."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | (F.col(p) > F.col(whole))
    count = lambda x: F.sum(x.cast("int")).cast("long")
    both = users.agg(count(bad).alias("part"), count(F.col(whole) > F.col("slots")).alias("whole"))  # in one reading
    row = lambda name, n: F.struct(F.lit(name).alias("check"), F.col(n).alias("n"))
    return both.select(F.inline(F.array(row("part_over_whole", "part"), row("whole_over_slots", "whole"))))


def paired_means(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """n, mean_diff, unpaired of value over users of both tables."""
    both = a.select("u", F.col(value).alias("x")).join(b.select("u", F.col(value).alias("y")), "u", "full")
    paired = F.col("x").isNotNull() & F.col("y").isNotNull()
    return both.agg(F.count(F.when(paired, 1)).alias("n"), F.round(F.avg(F.when(paired, F.col("y") - F.col("x"))), 6).alias("mean_diff"), F.count(F.when(~paired, 1)).alias("unpaired"))


def poisson_steps(most: int = 8) -> list[float]:
    """Chances that a Poisson(1) weight is at most 0, 1, ...: a uniform draw above the n-th of them weighs more than n."""
    out, term = [], math.exp(-1)
    for n in range(most):
        out.append((out[-1] if out else 0.0) + term)
        term /= n + 1
    return out


def bootstrap(diffs: DataFrame, value: str, repeats: int = 2000, seed: int = 7) -> DataFrame:
    """mean, low, high: 95 % interval of the mean by Poisson resampling; each row is weighted in all replicas where it stands.

    One md5 of seed|u|b gives the draws of four replicas; sums are partial before the shuffle, which carries one row per replica and task.
    """
    rows = diffs.select("u", F.col(value).alias("x")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((repeats - 1) // 4))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("u").cast("string"), F.col("b").cast("string")))
    rows = rows.select("x", "b", digest.alias("d"))
    four = F.array(*[F.struct(F.lit(q).alias("q"), ((F.conv(F.substring("d", 8 * q + 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32).alias("z")) for q in range(4)])
    rows = rows.select("x", "b", F.explode(four).alias("y")).select("x", (F.col("b") * 4 + F.col("y.q")).alias("r"), F.col("y.z").alias("z")).where(F.col("r") < repeats)
    weight = reduce(lambda s, t: s + (F.col("z") > t).cast("int"), poisson_steps(), F.lit(0))
    means = rows.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("x")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    point = diffs.agg(F.avg(value).alias("mean"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).join(F.broadcast(point))
