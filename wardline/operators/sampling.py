"""Deterministic sampling: order by a hash of the key and a seed instead of a random stream."""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.numbering import dense_ids
from wardline.sources.shared import stored, tasks


def draw(seed: int, *keys: str) -> Column:
    """md5 of seed|key|key..., equal in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


#: Draws for each wanted item.
DRAWS = 2
#: Items of a history that meet the draws as they are.
HISTORY = 4096


def number(text: Column) -> Column:
    """The first 12 hex digits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def negatives(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, seed: int) -> DataFrame:
    """u, i, place: the first n different items that are not among the user's ``seen`` (u, i), by hashed draws from the catalogue.

    A user's draws are one row until the n are found, so that only the history
    moves; of a history longer than HISTORY a row carries what the draws hit,
    and no row carries the catalogue. Where
    DRAWS * n draws give fewer than n (the catalogue is small, or nearly all
    seen), the unseen items that follow a hashed place in id order, cyclically,
    make up the rest, so that no one is short while there are items.
    """
    ids = dense_ids(items, "i", "d")
    size = ids.count()
    if not size:
        return users.select("u", F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("place")).limit(0)
    drawn_at = lambda t: number(F.concat_ws("|", F.lit(str(seed)), F.col("u").cast("string"), t.cast("string"))) % size
    # few users may come as one file: dealt by number, so that their draws are made in all tasks
    who = users.select("u").distinct().repartition(tasks(users.sparkSession), "u")
    taken = seen.select("u", "i").join(ids, "i").select("u", "d")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(max(0, DRAWS * n - 1))), drawn_at)
    piece = F.floor((F.row_number().over(Window.partitionBy("u").orderBy("d")) - 1) / HISTORY)
    had = taken.withColumn("piece", piece).groupBy("u", "piece").agg(F.collect_list("d").alias("had"))
    had = had.select("u", F.when(F.size("had") < HISTORY, F.col("had")).otherwise(F.array_intersect("had", drawn)).alias("had"))
    own = who.join(had.groupBy("u").agg(F.flatten(F.collect_list("had")).alias("had")), "u", "left")
    unseen = F.array_except(drawn, F.coalesce("had", F.array().cast("array<bigint>")))  # the first of each, in order
    draws = own.select("u", F.posexplode(F.slice(unseen, 1, n)).alias("place", "d")) if n > 0 else own.select("u", F.lit(0).alias("place"), F.lit(0).cast("long").alias("d")).limit(0)
    found = stored(draws.select("u", "d", (F.col("place") + 1).cast("long").alias("place")))
    have = found.groupBy("u").agg(F.count("*").alias("have"))
    short = who.join(have, "u", "left").fillna(0, ["have"]).where(F.col("have") < n).withColumn("start", drawn_at(F.lit(-1)))
    short, taken, parts = stored(short), taken.unionByName(found.select("u", "d")), [found]
    lo, reach = 0, 4 * n
    while lo < size and short.count():
        # the next stretch behind each short user's place, without what is taken
        steps = short.withColumn("o", F.explode(F.sequence(F.lit(lo), F.lit(min(lo + reach, size) - 1))))
        steps = steps.withColumn("d", (F.col("start") + F.col("o")) % size).join(taken, ["u", "d"], "left_anti")
        place = F.col("have") + F.row_number().over(Window.partitionBy("u").orderBy("o"))
        more = stored(steps.withColumn("place", place.cast("long")).where(F.col("place") <= n).select("u", "d", "place"))
        parts.append(more)
        have = more.groupBy("u").agg(F.max("place").alias("now"))
        short = stored(short.join(have, "u", "left").withColumn("have", F.coalesce("now", "have")).drop("now").where(F.col("have") < n))
        lo, reach = lo + reach, 8 * reach
    return reduce(DataFrame.unionByName, parts).join(ids, "d").select("u", "i", "place")


#: Leading hex digits of a draw whose counts come to the driver: at most 65,536 counts a stratum.
LEAD = 4


def marked(rows: DataFrame, stratum: str, sizes: dict, seed: int, *keys: str) -> DataFrame:
    """rows with _in: whether a row is among the first sizes[stratum] of its stratum in hash order.

    Counts by the draw's first digits say where each cut falls; only the rows that share the cut's digits are ranked, so no stratum is sorted in one task.
    """
    lead = F.substring(draw(seed, *keys), 1, LEAD)
    counts = rows.where(F.col(stratum).isin(list(sizes))).groupBy(F.col(stratum).alias("s"), lead.alias("p")).agg(F.count("*").alias("n")).collect()
    inside, edge = F.lit(False), F.lit(False)
    left = F.lit(0).cast("long")
    for value, want in sizes.items():
        at, rest = None, max(0, want)
        for r in sorted((r for r in counts if r["s"] == value), key=lambda r: r["p"]):
            if r["n"] > rest:
                at = r["p"]
                break
            rest -= r["n"]
        own = F.col(stratum) == F.lit(value)
        inside = inside | (own & (F.lit(True) if at is None else F.col("_p") < at))
        if at is not None and rest:
            edge = edge | (own & (F.col("_p") == at))
            left = F.when(own, F.lit(rest).cast("long")).otherwise(left)
    full = rows.withColumn("_p", lead).withColumn("_e", F.coalesce(edge, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, *keys), *keys))
    plain = full.where(~F.col("_e")).withColumn("_in", F.coalesce(inside, F.lit(False)))
    return plain.unionByName(full.where("_e").withColumn("_in", place <= left)).drop("_p", "_e")


def stratified(rows: DataFrame, key: str, stratum: str, sizes: dict, seed: int) -> DataFrame:
    """The first sizes[stratum] rows of each stratum in hash order; other strata go."""
    return marked(rows, stratum, sizes, seed, key).where("_in").drop("_in")


def hash_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """rows with part: calib for the first half-even round(share * n) in hash order, holdout after."""
    one = rows.withColumn("_s", F.lit(0))
    out = marked(one, "_s", {0: round(share * rows.count())}, seed, key)
    return out.withColumn("part", F.when(F.col("_in"), "calib").otherwise("holdout")).drop("_s", "_in")


def balanced(rows: DataFrame, positives: int, negatives_: int, seed: int, mix=(0.4, 0.4, 0.2)) -> DataFrame:
    """Rows (u, i, quadrant) up to the targets: liked and safe ones, and a mix of the three other quadrants.

    Shares are rounded half to even; what a quadrant lacks is made up from the
    others in the order of the mix.
    """
    names = ("like_unsafe", "dislike_safe", "dislike_unsafe")
    have = {r["quadrant"]: r["count"] for r in rows.groupBy("quadrant").count().collect()}
    want = [round(negatives_ * m) for m in mix]
    want[-1] = negatives_ - sum(want[:-1])
    take = [min(w, have.get(n, 0)) for w, n in zip(want, names, strict=True)]
    short = negatives_ - sum(take)
    for j, n in enumerate(names):
        more = min(short, have.get(n, 0) - take[j])
        take[j] += more
        short -= more
    sizes = {"like_safe": min(positives, have.get("like_safe", 0)), **dict(zip(names, take, strict=True))}
    return marked(rows, "quadrant", sizes, seed, "u", "i").where("_in").drop("_in")


def strictly_balanced(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (u, i, quadrant), of each of the four quadrants as many as the smallest has (none where one is absent)."""
    have = {r["quadrant"]: r["count"] for r in rows.groupBy("quadrant").count().collect()}
    names = ("like_safe", "like_unsafe", "dislike_safe", "dislike_unsafe")
    sizes = dict.fromkeys(names, min(have.get(n, 0) for n in names))
    return marked(rows, "quadrant", sizes, seed, "u", "i").where("_in").drop("_in")


def trial_draw(seed: int):
    return lambda t: number(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("u", "i", "j")], t.cast("string")))


def trial_negatives(rows: DataFrame, seen: DataFrame, size: int, per: int, trials: int, seed: int) -> DataFrame:
    """u, i, j (0 to per - 1) and neg for each distinct (u, i) of rows: the first of ``trials`` hashed draws from 0..size-1 that is not among the user's ``seen`` (u, i).

    Where all trials are seen one more draw picks among the unseen items
    themselves, so neg is null only for a user who has seen everything. A
    history of up to HISTORY items meets its user's rows as one list, and each
    trial is drawn only where those before it are seen, so no draw is shuffled;
    the draws of longer histories meet them in a join.
    """
    draw_ = trial_draw(seed)
    known = seen.select("u", F.col("i").cast("long").alias("x")).where(F.col("x").between(0, size - 1)).distinct()
    had = stored(known.groupBy("u").agg(F.array_sort(F.collect_list("x")).alias("had")))
    rows = rows.select("u", "i").distinct()
    short, many = had.where(F.size("had") <= HISTORY), had.where(F.size("had") > HISTORY).select("u")
    long = not many.isEmpty()
    plain = rows.join(many, "u", "left_anti") if long else rows
    own = plain.join(short, "u", "left").withColumn("had", F.coalesce("had", F.array().cast("array<bigint>"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    free = size - F.size("had")
    at = F.when(free > 0, draw_(F.lit(-1)) % free)  # the place among the unseen ones
    nth = at + F.size(F.filter(F.transform("had", lambda x, r: x - r), lambda x: x <= at))
    tried = [draw_(F.lit(t)) % size for t in range(trials)] if size else []
    neg = F.coalesce(*[F.when(~F.array_contains("had", x), x) for x in tried], nth) if size else F.lit(None)
    out = own.select("u", "i", "j", neg.cast("long").alias("neg"))
    if not long:
        return out
    return out.unionByName(joined_trials(rows.join(many, "u", "left_semi"), known.join(many, "u", "left_semi"), size, per, trials, seed))


def joined_trials(rows: DataFrame, known: DataFrame, size: int, per: int, trials: int, seed: int) -> DataFrame:
    """trial_negatives of distinct rows (u, i) and known (u, x): two trials come first, the others only for what they leave; seen items meet the draws in a
    join, so no row carries a history."""
    draw_ = trial_draw(seed)
    marked_ = known.withColumn("old", F.lit(True))
    left = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    done = []
    for lo, hi in ((0, min(2, trials)), (2, trials)):
        if lo < hi:
            tried = left.withColumn("t", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).withColumn("x", draw_(F.col("t")) % max(1, size))
            tried = tried.join(marked_, ["u", "x"], "left").groupBy("u", "i", "j").agg(F.min_by("x", F.when(F.col("old").isNull(), F.col("t"))).alias("neg"))
            tried = stored(tried if size else tried.withColumn("neg", F.lit(None).cast("long")))
            done.append(tried.where("neg is not null"))
            left = tried.where("neg is null").drop("neg")
    # the place among the unseen ones grows by one for each seen item at or below it: x - (seen items below x) <= place
    who = left.select("u").distinct()
    below = F.row_number().over(Window.partitionBy("u").orderBy("x")) - 1
    own = known.join(who, "u", "left_semi").select("u", (F.col("x") - below).alias("v"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("int").alias("j"))
    count = known.join(who, "u", "left_semi").groupBy("u").agg(F.count("*").alias("seen"))
    asked = left.join(count, "u", "left").withColumn("free", size - F.coalesce("seen", F.lit(0)))
    asked = asked.withColumn("v", F.when(F.col("free") > 0, draw_(F.lit(-1)) % F.greatest("free", F.lit(1))))
    both = own.unionByName(asked.where("free > 0").select("u", "v", F.lit(1).alias("asks"), F.col("i").cast("long").alias("i"), "j"))
    upto = F.sum(1 - F.col("asks")).over(Window.partitionBy("u").orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0))
    rest = both.withColumn("neg", F.col("v") + upto).where("asks = 1").select("u", "i", "j", "neg")
    none = asked.where("free <= 0").select("u", "i", "j", F.lit(None).cast("long").alias("neg"))
    return reduce(DataFrame.unionByName, [*done, rest, none])


def shuffled(rows: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """rows with place (1 first) in hash order within each key's bounded list."""
    w = Window.partitionBy(key).orderBy(draw(seed, key, value), value)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def shuffled_where_found(seed: int):
    """shuffled of a user's ranked rows for rank_catalogue's then: the places are given where the rows are found."""

    def done(rows: pa.RecordBatch):
        u, i = rows["u"].to_numpy(), rows["i"].to_numpy()
        drawn = np.frombuffer(b"".join(md5(f"{seed}|{a}|{b}".encode()).digest() for a, b in zip(u.tolist(), i.tolist(), strict=True)), ">u8").reshape(-1, 2)
        row = np.cumsum(np.append(False, u[1:] != u[:-1])) if len(u) else u
        order = np.lexsort((i, drawn[:, 1], drawn[:, 0], row))
        place = np.arange(1, len(u) + 1) - np.searchsorted(row, row)  # row is sorted
        yield pa.RecordBatch.from_arrays([pa.array(u[order]), pa.array(i[order]), pa.array(place)], names=["u", "i", "place"])

    return done, "u long, i long, place long"


def sample_n(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement in hash order; all of them for a negative n."""
    return rows if n < 0 else stratified(rows.withColumn("_s", F.lit(0)), key, "_s", {0: n}, seed).drop("_s")


def shuffled_histories(history: DataFrame, repeats: int, seed: int) -> DataFrame:
    """u, r, target, rest: per user and repeat the history in hash order, its last item apart. A history is one bounded list; users of one item go."""
    # only the history moves; its repeats are drawn and sorted where the user's list is
    own = history.groupBy("u").agg(F.collect_list("i").alias("all")).where(F.size("all") > 1)
    each = own.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("u").cast("string"), i.cast("string"))).alias("d"), i.alias("i"))
    lists = each.select("u", "r", F.array_sort(F.transform("all", drawn)).alias("x"))
    ids = F.col("x.i")
    return lists.select("u", "r", F.element_at(ids, -1).alias("target"), F.slice(ids, F.lit(1), F.size("x") - 1).alias("rest"))
