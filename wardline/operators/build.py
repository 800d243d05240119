"""Building data sets: valid ratings, eligible users, samples, dense ids, splits, history tables, risk look-ups, sequence merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.clean import to_int
from wardline.functions.policy import DIMS
from wardline.operators.history import keep_last, leave_last_two, ranked
from wardline.operators.numbering import dense_ids
from wardline.operators.sampling import draw, stratified


def event_time(unix: Column, *dates: Column) -> Column:
    """Seconds of the epoch: the stated ones, else the first date that parses (as midnight UTC), else 0."""
    midnight = lambda d: F.unix_date(F.to_date(d.cast("string").try_cast("date"))) * 86400
    return F.coalesce(to_int(unix), *[midnight(d) for d in dates], F.lit(0)).cast("long")


def valid_ratings(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (name, raw_item, score, ...) with a name, a positive score and an item of the catalogue."""
    rows = rows.where("name is not null and raw_item is not null and score > 0")
    return rows.join(items.select("raw_item").distinct(), "raw_item", "left_semi")


@dataclass(frozen=True)
class Bounds:
    """least, most: rated items of an eligible user; positives: liked ones at least; liked: score above which an item is liked; sizes: users by is_minor."""

    least: int
    most: int
    positives: int
    liked: int
    sizes: dict[bool, int]
    seed: int = 2028


def selected_users(users: DataFrame, rows: DataFrame, bounds: Bounds) -> DataFrame:
    """name, is_minor, u, total, positives: hash-drawn eligible users of each group, numbered in hash order of both together.

    users: name, is_minor. rows: valid ratings. Fails where a group has too few.
    """
    counts = rows.groupBy("name").agg(F.count("*").alias("total"), F.count_if(F.col("score") > bounds.liked).alias("positives"))
    pool = users.join(counts, "name").where(F.col("total").between(bounds.least, bounds.most) & (F.col("positives") >= bounds.positives))
    have = {r["is_minor"]: r["count"] for r in pool.groupBy("is_minor").count().collect()}
    if short := {k: n for k, n in bounds.sizes.items() if have.get(k, 0) < n}:
        raise ValueError(f"too few eligible users: {have} for {short}")
    drawn = stratified(pool, "name", "is_minor", bounds.sizes, bounds.seed)
    # the sample is bounded by sizes, so one window numbers it
    place = F.row_number().over(Window.orderBy(draw(bounds.seed + 2, "name"), "name"))
    return drawn.withColumn("u", (place - 1).cast("long"))


def interactions_of(chosen: DataFrame, rows: DataFrame, bounds: Bounds) -> DataFrame:
    """u, i, raw_item, score, ts, is_liked of the chosen users: a pair's last row by n; i numbers the raw items that occur."""
    own = rows.join(chosen.select("name", "u"), "name")
    last = keep_last(own.withColumn("v", F.struct("score", "ts")), ["u", "raw_item"], ["n"], "v")
    flat = last.select("u", "raw_item", F.col("v.score").alias("score"), F.col("v.ts").alias("ts"))
    ids = dense_ids(flat, "raw_item", "i")
    return flat.join(ids, "raw_item").select("u", "i", "raw_item", "score", "ts", (F.col("score") > bounds.liked).alias("is_liked"))


def liked_split(inter: DataFrame) -> DataFrame:
    """u, i, ts, split of the liked rows: the last is test, the one before valid."""
    return leave_last_two(inter.where("is_liked").select("u", "i", "ts"))


def history_table(split: DataFrame, inter: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """The training pairs with their interaction, user and item columns and ranks in the user's history.

    A column of users or items that is there already gets the suffix _user or _item.
    """
    rows = split.where("split = 'train'").select("u", "i").distinct().join(inter, ["u", "i"])
    for other, key, suffix in ((users, "u", "_user"), (items, "i", "_item")):
        names = {c: c + suffix for c in other.columns if c != key and c in rows.columns}
        rows = rows.join(other.withColumnsRenamed(names), key, "left")
    return ranked(rows)


def risk_lookup(items: DataFrame, links: DataFrame, guide: DataFrame, details: DataFrame) -> DataFrame:
    """items (i, raw) with tconst, five codes, is_adult, risk_missing, risk_max, risk_mean, risk_sum, through links (raw, tconst), guide (tconst, is_adult, codes) and details (raw, adult).

    Without a link or a guide row codes are 1 and risk_missing holds; an adult mark of either source counts.
    """
    marks = guide.select("tconst", F.col("is_adult").alias("g_adult"), *[F.col(d).alias(f"g_{d}") for d in DIMS], F.lit(True).alias("known"))
    rows = items.join(links, "raw", "left").join(marks, "tconst", "left").join(details, "raw", "left")
    codes = [F.coalesce(F.col(f"g_{d}"), F.lit(1)).cast("long").alias(d) for d in DIMS]
    rows = rows.select("i", "raw", "tconst", *codes, (F.coalesce("g_adult", F.lit(False)) | F.coalesce("adult", F.lit(False))).alias("is_adult"), F.col("known").isNull().alias("risk_missing"))
    total = sum((F.col(d) for d in DIMS[1:]), F.col(DIMS[0]))
    return rows.withColumns({"risk_max": F.greatest(*DIMS), "risk_mean": F.round(total / 5, 4), "risk_sum": total})


def merged_sequences(base: DataFrame, more: DataFrame, held_out: DataFrame) -> DataFrame:
    """u, i, source of base rows and of those more rows that are new: not in base, not held out, once each (the first by n)."""
    once = more.groupBy("u", "i").agg(F.min("n").alias("n"))
    fresh = once.join(base.select("u", "i"), ["u", "i"], "left_anti").join(held_out.select("u", "i"), ["u", "i"], "left_anti")
    return base.select("u", "i", F.lit("base").alias("source")).unionByName(fresh.select("u", "i", F.lit("more").alias("source")))


def merge_counts(base: DataFrame, more: DataFrame, held_out: DataFrame) -> DataFrame:
    """One row: rows of more, those in base, those held out, repeated ones, and those added."""
    pairs = more.groupBy("u", "i").agg(F.count("*").alias("c"))
    mark = lambda rows, name: rows.select("u", "i").distinct().withColumn(name, F.lit(True))
    both = pairs.join(mark(base, "b"), ["u", "i"], "left").join(mark(held_out, "h"), ["u", "i"], "left")
    b, h = F.coalesce("b", F.lit(False)), F.coalesce("h", F.lit(False))
    total = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).cast("long")
    return both.agg(
        total(F.lit(True), F.col("c")).alias("n_more"), total(b, F.col("c")).alias("n_in_base"), total(~b & h, F.col("c")).alias("n_held_out"),
        total(~b & ~h, F.col("c") - 1).alias("n_repeated"), total(~b & ~h, F.lit(1)).alias("n_added"),
    )


def id_maps(rows: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """group and ``ids``: a map from key to value per group; the later value (by order of values) wins a repeated key."""
    last = rows.groupBy(group, key).agg(F.max(value).alias("v"))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "v")))).alias("ids"))


def place_maps(rows: DataFrame, least: int = 1) -> DataFrame:
    """u and ``ids``: per user of at least so many items a map from item to its place (from 1) by (ts, i). rows: u, i, ts, one row a pair.

    A history is one list, as is the map, and it is sorted there: what id_maps makes of ranked rows, but no window sorts all rows of a task.
    """
    own = rows.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("ts", "i"))).alias("x")).where(F.size("x") >= least)
    placed = F.transform("x", lambda s, k: F.struct(s["i"].alias("i"), (k + 1).cast("long").alias("v")))
    return own.select("u", F.map_from_entries(F.array_sort(placed)).alias("ids"))


def shuffled_together(parts: list[DataFrame], key: str, seed: int) -> DataFrame:
    """The rows of all parts, numbered from 0 in hash order. Parts are bounded samples."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("place", (F.row_number().over(Window.orderBy(draw(seed, key), key)) - 1).cast("long"))


def assertions(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n: rows for which a condition does not hold (null counts as not)."""
    one = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def head(rows: DataFrame, most: int, skip: int, *order: str) -> DataFrame:
    """A stated stretch of the rows in order; all from skip on for most of 0 or less."""
    rows = rows.orderBy(*order).offset(skip)
    return rows.limit(most) if most > 0 else rows
