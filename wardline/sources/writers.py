"""Writers. Each writes a folder through Spark's committers; nothing is collected but small summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rating_lines(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=False)


def negative_lines(pool: DataFrame, path: str) -> None:
    """(u,pos) and the pool's other items in place order; a pool is bounded by its size."""
    lists = pool.where("place > 0").groupBy("u", "pos").agg(F.array_sort(F.collect_list(F.struct("place", "i"))).alias("x"))
    line = F.concat_ws("\t", F.concat(F.lit("("), "u", F.lit(","), "pos", F.lit(")")), F.transform("x", lambda s: s["i"].cast("string")))
    lists.select(line.alias("value")).write.mode("overwrite").text(path)


def csv_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def json_lines(rows: DataFrame, path: str, metadata: bool = True, append: bool = False) -> None:
    out = rows if metadata else rows.drop("metadata")
    out.write.mode("append" if append else "overwrite").json(path)


def metric_table(rows: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with every double at fixed decimals."""
    shown = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").csv(path, header=True)


#: A summary that goes to the driver has at most so many rows.
MOST_SUMMARY = 10_000


def summary_json(rows: DataFrame) -> str:
    """The rows of a small aggregate as JSON text."""
    got = rows.limit(MOST_SUMMARY + 1).collect()
    if len(got) > MOST_SUMMARY:
        raise ValueError("not a summary")
    return json.dumps([r.asDict(recursive=True) for r in got], ensure_ascii=False, default=str, indent=1)


def document(spark: SparkSession, value: object, path: str) -> None:
    """One JSON document: written beside its place and then renamed, so that a reader finds the old one or the new one whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, aside = hadoop.Path(path), hadoop.Path(f"{path}.tmp")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"{path} could not be written")


def copied(rows: DataFrame, path: str) -> None:
    """The rows unchanged under path, and the proof: a differing fingerprint is an error."""
    rows.write.mode("overwrite").parquet(path)
    there = rows.sparkSession.read.parquet(path)
    if fingerprint(there.select(*rows.columns)).first() != fingerprint(rows).first():
        raise ValueError(f"the copy under {path} differs")


#: Bytes of a piece of a score matrix that a task holds before they are written.
MATRIX_BYTES = 32 << 20


def score_matrix(rows: DataFrame, path: str, ordered: bool = False) -> None:
    """u, scores as Parquet: a row of the matrix is one row, found by its u without reading the others' pages. ordered: the rows come as score_rows gives them.

    Rows are long, so the size of what is held is looked at with every one, not after the first hundred.
    """
    rows = rows.select("u", "scores")
    rows = rows if ordered else rows.repartitionByRange("u").sortWithinPartitions("u")
    out = rows.write.mode("overwrite").option("parquet.block.size", MATRIX_BYTES)
    for of in ("page", "block"):
        out = out.option(f"parquet.{of}.size.row.check.min", 1).option(f"parquet.{of}.size.row.check.max", 1)
    out.parquet(path)


def sequence_lines(rows: DataFrame, path: str) -> None:
    """"u i" lines with ids from 1, in the order of (u, pos). rows: u, i, pos from 0."""
    ordered = rows.repartitionByRange("u").sortWithinPartitions("u", "pos")
    ordered.select(F.concat_ws(" ", F.col("u") + 1, F.col("i") + 1).alias("value")).write.mode("overwrite").text(path)


def tensor(rows: DataFrame, path: str, name: str) -> None:
    """One tensor of a checkpoint folder: id, values."""
    rows.select("id", "values").write.mode("overwrite").parquet(f"{path}/{name}")


def private_columns_dropped(rows: DataFrame, private: tuple[str, ...] = ("username", "birth_date", "join_date", "gender", "location")) -> DataFrame:
    return rows.drop(*private)


def fingerprint(rows: DataFrame) -> DataFrame:
    """rows, digest: an order-free fingerprint, to tell that a copy is the same. The sum of row hashes counts every repeat of a row."""
    line = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}), 256)
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("digest"))
