"""Readers of the file formats of ranking data. All are one lazy scan; bad rows are dropped, not raised."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.clean import first_of, is_minor, loose_bucket, split_line, strip, title_id, to_bool, to_float, to_int


def column_key(name: str) -> str:
    """Lower case, marks and spaces as one underscore, no byte-order mark."""
    out = "".join(c if c.isalnum() else "_" for c in name.replace("﻿", "").strip().lower())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


def normalised(df: DataFrame) -> DataFrame:
    """Columns renamed by column_key; a repeated name gets a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        k = column_key(c)
        seen[k] = seen.get(k, 0) + 1
        names.append(k if seen[k] == 1 else f"{k}_{seen[k]}")
    return df.toDF(*names)


def pick(df: DataFrame, *aliases: str) -> Column:
    """The first of the aliases that df has (names compared by column_key), else null."""
    have = {column_key(c): c for c in df.columns}
    for a in aliases:
        if column_key(a) in have:
            return F.col(f"`{have[column_key(a)]}`")
    return F.lit(None).cast("string")


def ratings(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """u, i, rating, ts of lines in any of the separators; headers and rows without two ids of at least 0 go."""
    parts = split_line(F.col("value"))
    rows = spark.read.text(path).select(parts.alias("p"))
    get = lambda n: F.get("p", F.lit(n))
    # one struct a line, behind an explode that no filter passes: else the filter takes the line apart anew for each id that it asks
    row = F.struct(to_int(get(0)).alias("u"), to_int(get(1)).alias("i"), to_float(get(2)).alias("rating"), to_int(get(3)).alias("ts"))
    rows = rows.select(F.explode_outer(F.array(row)).alias("r")).select("r.*")
    rows = rows.where((F.col("u") >= 0) & (F.col("i") >= 0))
    return rows if split is None else rows.withColumn("split", F.lit(split))


def dimensions(rows: DataFrame) -> DataFrame:
    """num_users, num_items: largest id plus one."""
    return rows.agg((F.coalesce(F.max("u"), F.lit(-1)) + 1).alias("num_users"), (F.coalesce(F.max("i"), F.lit(-1)) + 1).alias("num_items"))


def dat(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``::``-separated Latin-1 rows under the given names."""
    rows = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="::", quote="", schema=", ".join(f"`{n}` string" for n in names))
    return rows.where(F.col(f"`{names[0]}`").isNotNull())


def negative_pool(spark: SparkSession, path: str) -> DataFrame:
    return pool_lines(spark.read.text(path))


def pool_lines(lines: DataFrame) -> DataFrame:
    """u, pos, place, i: the pool of each "(u,pos)" line (or of a line that opens with two ids); the positive is place 0. lines: value."""
    line = strip(F.col("value"))
    head = r"^\((\d+)\s*,\s*(\d+)\)"
    marked = F.regexp_like(line, F.lit(head))
    parts = F.split(line, r"\s+")
    u = F.when(marked, F.regexp_extract(line, head, 1)).otherwise(F.get(parts, F.lit(0)))
    pos = F.when(marked, F.regexp_extract(line, head, 2)).otherwise(F.get(parts, F.lit(1)))
    rest = F.when(marked, F.regexp_extract_all(F.regexp_replace(line, head, ""), F.lit(r"\d+"), F.lit(0))).otherwise(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))))
    rows = lines.select(to_int(u).alias("u"), to_int(pos).alias("pos"), rest.alias("rest")).where("u is not null and pos is not null")
    rows = rows.select("u", "pos", F.posexplode(F.concat(F.array(F.col("pos").cast("string")), "rest")).alias("place", "i"))
    return rows.select("u", "pos", F.col("place").cast("long").alias("place"), to_int(F.col("i")).alias("i")).where("i is not null")


#: Separators that a CSV may have, in order of preference where they are equally frequent.
SEPARATORS = (",", "\t", ";", "|")


def separator(spark: SparkSession, path: str) -> str:
    """The separator that the header line has most of."""
    first = spark.read.text(path).where(strip(F.col("value")) != "").limit(1).collect()
    line = first[0]["value"] if first else ""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def table(spark: SparkSession, path: str, sep: str | None = ",", needs: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, all columns text, names normalised. sep None: told by the header line. A missing header or needed column is an error."""
    rows = normalised(spark.read.csv(path, header=True, sep=sep or separator(spark, path), quote='"', escape='"', multiLine=True))
    if not rows.columns:
        raise ValueError(f"{path} has no header")
    if missing := [c for c in needs if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None, most: int = 0, skip: int = 0) -> DataFrame:
    """One object a line; blank and broken lines go. skip and most: the first lines of the files in path order that are left out, and how many follow (0: all)."""
    if not most and not skip:
        reader = spark.read.option("mode", "DROPMALFORMED")
        return (reader if schema is None else reader.schema(schema)).json(path)
    lines = spark.read.text(path).where(strip(F.col("value")) != "").select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    lines = lines.orderBy("f", "n").offset(skip)
    rows = (lines.limit(most) if most else lines).select("value")
    kind = schema if schema is not None else F.schema_of_json(F.lit(rows.first()["value"]))
    return rows.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("x")).where("x is not null").select("x.*")


def last_rows(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key in file order."""
    names = [c for c in rows.columns if c != key]
    numbered = rows.select("*", F.monotonically_increasing_id().alias("_n"))
    last = numbered.groupBy(key).agg(F.max(F.struct("_n", *names)).alias("_x"))
    return last.select(key, *[F.col(f"_x.{c}").alias(c) for c in names])


CODES = ("sex", "violence", "profanity", "drug", "intense")


def item_dimension(spark: SparkSession, path: str) -> DataFrame:
    """i, title, bucket, is_adult and five codes (1 where missing) of an item table under any of its column names; the last row of an id wins."""
    rows = table(spark, path, None)
    codes = [to_int(pick(rows, f"{d}_code", d), 1).alias(d) for d in CODES]
    out = rows.select(to_int(pick(rows, "inner_item_id", "item_id", "iid")).alias("i"), pick(rows, "title", "name").alias("title"), loose_bucket(pick(rows, "rating_bucket", "rating")).alias("bucket"), (to_int(pick(rows, "isAdult", "is_adult"), 0) == 1).alias("is_adult"), *codes)
    return last_rows(out.where("i >= 0"), "i")


def user_dimension(spark: SparkSession, path: str) -> DataFrame:
    """u, is_minor, age_desc of a user table under any of its column names; the last row of an id wins."""
    rows = table(spark, path, None)
    flag, told, age = pick(rows, "is_minor", "minor"), pick(rows, "age_desc", "age_group"), to_int(pick(rows, "age", "age_at_join"))
    minor = is_minor(F.when(strip(flag) != "", to_bool(flag)), told, age)
    out = rows.select(to_int(pick(rows, "inner_user_id", "user_id", "uid")).alias("u"), minor.alias("is_minor"), told.alias("age_desc"))
    return last_rows(out.where("u >= 0"), "u")


def item_texts(spark: SparkSession, path: str) -> DataFrame:
    """i, text of an item table: title, genres, studio and source joined by "; " where they are given."""
    rows = table(spark, path, None)
    parts = [F.nullif(strip(pick(rows, *names)), F.lit("")) for names in (("title", "name"), ("genres", "genre"), ("studio",), ("source",))]
    return last_rows(rows.select(to_int(pick(rows, "inner_item_id", "item_id", "anime_id")).alias("i"), F.concat_ws("; ", *parts).alias("text")).where("i is not null"), "i")


def factor_table(spark: SparkSession, path: str, role: str) -> DataFrame:
    """id, vector of the table of a checkpoint folder whose name says users or items; a checkpoint is one Parquet folder per tensor, rows id and values."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(str(f.getPath().getName()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory())
    found = [n for n in names if role in column_key(n) and any(w in column_key(n) for w in ("embed", "factor"))] or [n for n in names if role in column_key(n)]
    if not found:
        raise ValueError(f"no tensor of {role} among {', '.join(names)}")
    return spark.read.parquet(f"{path}/{found[0]}").select(F.col("id"), F.col("values").alias("vector"))


def manifest(spark: SparkSession, path: str, needs: tuple[str, ...]) -> dict:
    """A JSON configuration, with the keys that it must have."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    found = json.loads(rows[0]["value"]) if rows else {}
    if missing := [k for k in needs if k not in found]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """u, profile (text) of profiles without parse_error, the last line of a user winning."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select(to_int(F.get_json_object("value", "$.user_id")).alias("u"), F.get_json_object("value", "$.profile").alias("profile"), F.coalesce(F.get_json_object("value", "$.parse_error"), F.lit("false")).alias("bad"), "f", "n")
    rows = rows.where((F.col("bad") != "true") & F.col("u").isNotNull())
    return rows.groupBy("u").agg(F.max(F.struct("f", "n", "profile")).alias("x")).select("u", F.col("x.profile").alias("profile"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """u, i, psg_pred, p1, margin: ids and values under any alias in the record or its metadata, 0 by default, the last line winning."""
    field = lambda *names: first_of(*[F.get_json_object("value", f"$.{p}{n}") for n in names for p in ("", "metadata.")])
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select(
        to_int(field("user_id", "inner_user_id", "uid")).alias("u"),
        to_int(field("item_id", "inner_item_id", "candidate_inner_item_id", "iid")).alias("i"),
        to_int(field("psg_pred", "pred", "prediction"), 0).alias("psg_pred"),
        to_float(field("p1", "prob_1"), 0.0).alias("p1"),
        to_float(field("margin_1_minus_0", "margin"), 0.0).alias("margin"),
        "f",
        "n",
    ).where("u is not null and i is not null")
    last = rows.groupBy("u", "i").agg(F.max(F.struct("f", "n", "psg_pred", "p1", "margin")).alias("x"))
    return last.select("u", "i", "x.psg_pred", "x.p1", "x.margin")


def links(spark: SparkSession, path: str) -> DataFrame:
    """movie_id, tconst."""
    rows = table(spark, path)
    return rows.select(to_int(pick(rows, "movieId", "movie_id")).alias("movie_id"), title_id(pick(rows, "imdbId", "imdb_id")).alias("tconst")).where("movie_id is not null and tconst is not null")


def keyed_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """key and fields of one JSON object of objects. The object is one value, so it has to fit a task."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{schema}>>").alias("m"))
    return rows.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def guide(spark: SparkSession, path: str) -> DataFrame:
    """tconst, is_adult and five codes, 1 where missing."""
    rows = table(spark, path)
    codes = [to_int(pick(rows, f"{d}_code"), 1).alias(d) for d in ("sex", "violence", "profanity", "drug", "intense")]
    return rows.select(title_id(pick(rows, "tconst", "imdb_id")).alias("tconst"), (to_int(pick(rows, "isAdult"), 0) == 1).alias("is_adult"), *codes).where("tconst is not null")


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; right's value wins where it has one."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    both = left.alias("l").join(right.alias("r"), key, "full")
    cols = [F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) if c in shared else F.col(c) for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    return both.select(key, *cols)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """u, i of "user item" lines with ids from 1, as ids from 0."""
    rows = ratings(spark, path)
    return rows.where("u >= 1 and i >= 1").select((F.col("u") - 1).alias("u"), (F.col("i") - 1).alias("i"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with float arrays."""
    return spark.read.parquet(path)
