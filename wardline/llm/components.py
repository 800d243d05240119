"""Connected components by alternating star contractions; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())


def components(edges: DataFrame, rows: int) -> DataFrame:
    """node, component (the smallest node of its component) for every node of an edge (u, v); single nodes have no row. rows: about how many edges there are.

    Each round points all larger neighbours of a node, then all smaller ones,
    at its smallest neighbour. A hub's edges are split by the engine's skew
    join; its minimum is pre-aggregated.
    """
    e = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    mark = _mark(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), 4 * mark[0])
        was, mark = mark, _mark(e)
        if mark == was:
            break
    own = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
