"""Conformal calibration of a safety threshold, and harm-vote reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.sources.shared import settle, stored, tasks

#: Accepted slots of a list.
SLOTS = 20


def thresholds(spark, n: int = 100) -> DataFrame:
    """g, gamma: n evenly spaced thresholds of [0, 1], and one above 1 that rejects everything."""
    rows = spark.range(n).select(F.col("id").alias("g"), (F.col("id") / (n - 1)).alias("gamma"))
    return rows.union(spark.range(1).select(F.lit(n).cast("long").alias("g"), F.lit(1.0000000000000002).alias("gamma")))


def list_curves(offsets: np.ndarray, level: np.ndarray, unsafe: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """lists x n thresholds: the unsafe share of the first slots accepted items.

    Item j of a list (in its order) is accepted at the thresholds below its
    level, but for those at which slots earlier items already are: these lie
    below the slots-th largest level so far. So each item adds to one stretch of
    thresholds, kept as differences; lists advance together, an item at a time.
    """
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    longest = np.append(size[order], 0)
    steps = np.zeros((len(size), n + 1))
    largest = np.zeros((len(size), slots), np.int64)
    for j in range(int(longest[0])):
        rows = order[: np.searchsorted(-longest, -j)]  # lists of more than j items
        at = offsets[rows] + j
        least = largest[rows].argmin(1)
        first, last = largest[rows, least], level[at]
        inside = last > first
        rows, least, first, last, flag = rows[inside], least[inside], first[inside], last[inside], unsafe[at[inside]]
        steps[rows, first] += flag
        steps[rows, last] -= flag
        largest[rows, least] = last
    return np.cumsum(steps, 1)[:, :n] / slots


def risk_curve(ranked: DataFrame, grid: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """g, gamma, raw, envelope, adjusted over users of ranked (u, rank, safety, unsafe).

    A user's risk at gamma is the unsafe share of the first SLOTS items of
    safety at least gamma; the envelope takes the largest risk at gamma or
    above; adjusted is (n * envelope + 1) / (n + 1). With history (u, i, score and
    unsafe of past items), these are merged into the user's list (ranked then
    also holds i and score) by score, ties to the smaller i, and accepted at any
    gamma. Users of the history alone are left out.
    """
    spark = ranked.sparkSession
    steps = sorted((r["gamma"], r["g"]) for r in grid.collect())  # the thresholds, not the data
    gammas = np.array([x for x, _ in steps])
    listed = lambda rows: rows.groupBy("u").agg(F.collect_list(F.struct("a", "b", "safety", "unsafe")).alias("x"))
    of = lambda rows, a, b, safety: rows.select("u", a.cast("double").alias("a"), b.cast("long").alias("b"), safety.cast("double").alias("safety"), F.col("unsafe").cast("double").alias("unsafe"))
    if history is None:
        lists = listed(of(ranked, F.col("rank"), F.lit(0), F.col("safety"))).select("u", F.array_sort("x").alias("x"))
    else:
        # a user's two lists meet as one row each: the ranking behind one is worked out once
        past = listed(of(history, -F.col("score"), F.col("i"), F.lit(None))).select("u", F.col("x").alias("always"))
        own = listed(of(ranked, -F.col("score"), F.col("i"), F.col("safety"))).join(past, "u", "left")
        known = F.filter(F.transform("always", lambda x: x["b"]), lambda b: b.isNotNull())
        new = F.when(F.col("always").isNull(), F.col("x")).otherwise(F.filter("x", lambda x: ~F.coalesce(F.array_contains("known", x["b"]), F.lit(False))))
        lists = own.withColumn("known", known).select("u", F.array_sort(F.concat(new, F.coalesce("always", F.array().cast(own.schema["x"].dataType)))).alias("x"))

    def sums(batches):
        total, n = np.zeros((2, len(gammas))), 0
        for batch in batches:
            off = batch["x"].offsets.to_numpy()
            flat = batch["x"].flatten()
            safety = flat.field("safety").to_numpy(zero_copy_only=False)
            level = np.where(np.isnan(safety), len(gammas), np.searchsorted(gammas, safety, "right"))
            risk = list_curves(off - off[0], level, flat.field("unsafe").to_numpy(zero_copy_only=False), len(gammas))
            total += np.stack([risk.sum(0), np.maximum.accumulate(risk[:, ::-1], 1)[:, ::-1].sum(0)])
            n += len(risk)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gammas))), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(len(gammas), n))], names=["at", "r", "e", "m"])

    parts = lists.select("x").mapInArrow(sums, "at long, r double, e double, m long").groupBy("at").agg(F.sum("r").alias("r"), F.sum("e").alias("e"), F.sum("m").alias("n"))
    names = F.broadcast(spark.createDataFrame([(k, g, x) for k, (x, g) in enumerate(steps)], "at long, g long, gamma double"))
    out = parts.join(names, "at").select("g", "gamma", (F.col("r") / F.col("n")).alias("raw"), (F.col("e") / F.col("n")).alias("envelope"), "n")
    return out.withColumn("adjusted", (F.col("n") * F.col("envelope") + 1) / (F.col("n") + 1))


def choose(curve: DataFrame, fractions: list[float]) -> DataFrame:
    """fraction, alpha, g: the first threshold whose adjusted risk is at most fraction * (raw risk at threshold 0); else the last."""
    curve = settle(curve)  # a row for each threshold, read twice; the ranking behind it is worked out once
    base = curve.where("g = 0").select(F.col("raw").alias("base"))
    rows = curve.join(F.broadcast(base), F.lit(True)).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    alpha = F.col("base") * F.col("fraction")
    return rows.groupBy("fraction").agg(F.max(alpha).alias("alpha"), F.coalesce(F.min(F.when(F.col("adjusted") <= alpha, F.col("g"))), F.max("g")).alias("g"))


def select_safe(ranked: DataFrame, gamma: float, history: DataFrame | None = None) -> DataFrame:
    """u, i, place: each user's first SLOTS items of safety at least gamma by score; with history (safe past items and their scores) these are merged in whatever their safety."""
    rows = ranked.where(F.col("safety") >= gamma).select("u", "i", "score")
    if history is not None:
        # dealt by user once: what follows, equal rows and places, happens there
        rows = rows.unionByName(history.select("u", "i", "score")).repartition(tasks(rows.sparkSession), "u").distinct()
    w = Window.partitionBy("u").orderBy(F.desc("score"), "i")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= SLOTS).select("u", "i", "place")


def alike(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, kind: users of equal is_minor whose lists (bounded pools of rank and i) are equal have the least of them as kind; and the kinds' rows: u, is_minor, rank, i."""
    lists = stored(ranked.groupBy("u", "is_minor").agg(F.array_sort(F.collect_list(F.struct("rank", "i"))).alias("x")))
    kinds = stored(lists.groupBy(F.col("is_minor").alias("m"), F.col("x").alias("y")).agg(F.min("u").alias("kind")))
    own = lists.join(kinds, (F.col("x") == F.col("y")) & F.col("is_minor").eqNullSafe(F.col("m"))).select("u", "kind")
    return own, kinds.select(F.col("kind").alias("u"), F.col("m").alias("is_minor"), F.inline("y"))


def vote_rerank(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """u, i, votes, place: items by votes for being the more harmful (both orders), then by rank.

    judged: is_minor, lo, hi, choice_fwd, choice_rev (0 the first shown, 1 the
    second, 2 neither). Pairs stay inside one user's bounded pool, and those of
    users with equal pools are counted once.
    """
    own, ranked = alike(ranked)
    a = ranked.select("u", "is_minor", F.col("i").alias("x"), F.col("rank").alias("rx"))
    b = ranked.select("u", F.col("i").alias("y"), F.col("rank").alias("ry"))
    pairs = a.join(b, "u").where("rx < ry").select("u", "is_minor", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    low = (F.col("choice_fwd") == 0).cast("int") + (F.col("choice_rev") == 1).cast("int")
    high = (F.col("choice_fwd") == 1).cast("int") + (F.col("choice_rev") == 0).cast("int")
    found = pairs.join(judged, ["is_minor", "lo", "hi"]).select("u", F.explode(F.array(F.struct(F.col("lo").alias("i"), low.alias("v")), F.struct(F.col("hi").alias("i"), high.alias("v")))).alias("x"))
    votes = found.groupBy("u", F.col("x.i").alias("i")).agg(F.sum("x.v").alias("votes"))
    rows = ranked.join(votes, ["u", "i"], "left").fillna(0, ["votes"])
    w = Window.partitionBy("u").orderBy("votes", "rank")
    placed = rows.select(F.col("u").alias("kind"), "i", F.col("votes").cast("long").alias("votes"), F.row_number().over(w).cast("long").alias("place"))
    return own.join(placed, "kind").select("u", "i", "votes", "place")


def parse_choice(text):
    """0 for A, 1 for B, 2 for NONE after an equals sign; null for anything else, which is an error and not safety."""
    mark = F.upper(F.regexp_extract(text, r"(?i)^\s*=\s*(NONE|A|B)(\b|$)", 1))
    return F.when(mark == "A", 0).when(mark == "B", 1).when(mark == "NONE", 2)
