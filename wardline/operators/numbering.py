"""Numbers from 1 along any order, and dense ids, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.shared import settle, tasks

#: monotonically_increasing_id() holds the partition above this bit and the place inside it below.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with ``name``: their place from 1 in the given order.

    Two passes: the rows are range-sorted once and settled with their range and
    place in it; the ranges' counts (one number a range) give each range's
    offset. Rows that tie in the whole order take the places of their group in
    any order, and spread over several ranges. Keys may be of any sortable type.
    """
    spark = rows.sparkSession
    # a group of ties is cut by the row's own number, which takes no part in the order otherwise
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    laid = dealt.repartitionByRange(tasks(spark), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    laid = settle(laid.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS)
    before, offsets = 0, []
    for r in sorted(laid.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return laid.join(offsets, part == F.col("_part")).select(*[F.col(f"`{c}`") for c in rows.columns], place.alias(name))


def dense_ids(keys: DataFrame, column: str, name: str, first: int = 0) -> DataFrame:
    """Contiguous ids from ``first`` in the order of the distinct non-null keys: numbers, strings, hashes."""
    own = keys.select(column).where(F.col(column).isNotNull()).distinct()
    return numbered(own, [F.col(column)], name).withColumn(name, F.col(name) + (first - 1))


def extended_ids(known: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """known (column, name) and, behind its largest id, ids of the keys that it lacks, in their order; ids once given stay."""
    new = keys.select(column).distinct().join(known.select(column), column, "left_anti")
    top = known.agg(F.coalesce(F.max(name), F.lit(-1))).first()[0]
    return known.select(column, name).unionByName(dense_ids(new, column, name, top + 1))
