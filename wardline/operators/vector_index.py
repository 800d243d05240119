"""A stored vector index: an inverted file of k-means cells, built once and searched often.

``build_index`` fits the cells on a bounded sample and deals every vector to its
nearest centre; vectors lie as Parquet by cell, beside one row a cell with its
centre, radius and size. ``search`` deals queries to cells: the best ``probes``
cells of each give a first k best; the exact mode then visits every further cell
whose bound q . centre + |q| radius reaches the k-th score, so its rows are
those of a full scan. A cell with many vectors is cut by a hash into parts of
about PART vectors, which its queries visit one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.operators.retrieval import NEAR, Best, stacked
from wardline.sources.shared import settle

#: Vectors that the cells are fitted on, at most: the sample reaches the driver.
SAMPLE = 20_000
#: Vectors of one part of a cell, about.
PART = 50_000
#: Score cells that a worker holds at once.
SCORES = 1 << 22


def fitted(sample: np.ndarray, cells: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres by Lloyd's steps from distinct rows of the sample; an empty cell takes the row farthest from its centre."""
    distinct = np.unique(sample, axis=0)
    r = np.random.default_rng(seed)
    centres = distinct[r.permutation(len(distinct))[: min(cells, len(distinct))]].copy()
    for _ in range(rounds):
        own, far = nearest_centre(sample, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        empty = np.flatnonzero(~full)
        centres[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre (the first of equals) and its distance."""
    gap = (centres**2).sum(1)[None, :] - 2 * vectors @ centres.T
    own = gap.argmin(1)
    return own, np.sqrt(((vectors - centres[own]) ** 2).sum(1))


def build_index(vectors: DataFrame, path: str, cells: int, seed: int = 7) -> None:
    """Write the index of vectors (c, cv of one length; rows with a null are left out) under path: ``vectors`` by cell, and ``cells``."""
    rows = vectors.select(F.col("c").cast("long").alias("c"), F.col("cv").cast("array<double>").alias("cv")).where("c is not null and cv is not null")
    spark, n = vectors.sparkSession, rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE) if share < 1 else rows
    sample = drawn.toArrow()
    centres = fitted(stacked(sample["cv"]), cells, seed) if sample.num_rows else np.zeros((1, 1))

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                own, far = nearest_centre(stacked(batch["cv"]), centres)
                yield pa.RecordBatch.from_arrays([batch["c"], batch["cv"], pa.array(own.astype(np.int32)), pa.array(far)], names=["c", "cv", "cell", "far"])

    laid = rows.mapInArrow(dealt, "c long, cv array<double>, cell int, far double")
    laid.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    size = spark.read.schema("c long, cv array<double>, far double, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    names = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(centres)], "cell int, centre array<double>")
    names.join(size, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 4, exact: bool = True, digits: int = 9) -> DataFrame:
    """q, c, score, rank: the k indexed vectors of largest inner product for each query (q, qv), ties to the smaller c.

    exact: the rows of a full scan; else of the probes best cells alone. Scores
    are rounded, so that equal vectors tie.
    """
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # one row a cell
    asked = queries.select("q", F.col("qv").cast("array<double>").alias("qv")).where("q is not null and qv is not null")
    if not cells.num_rows:
        return spark.createDataFrame([], "q long, c long, score double, rank int")
    ids, centres = cells["cell"].to_numpy(), stacked(cells["centre"])
    radius, parts = cells["radius"].to_numpy(), np.maximum(1, -(-cells["n"].to_numpy() // PART)).astype(np.int32)
    slack = 10.0**-digits

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                v = stacked(batch["qv"])
                like = v @ centres.T
                bound = like + np.sqrt((v**2).sum(1))[:, None] * radius[None, :]
                order = np.argsort(-like, axis=1, kind="stable")
                for name, at in (("near", order[:, :probes]), ("rest", order[:, probes:])):
                    row = np.repeat(np.arange(len(v)), at.shape[1])
                    at = at.ravel()
                    copies = parts[at]
                    part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    row, at = np.repeat(row, copies), np.repeat(at, copies)
                    if len(row) and (name == "near" or exact):
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays([batch["q"].take(take), batch["qv"].take(take), pa.array(ids[at]), pa.array(part.astype(np.int32)), pa.array(bound[row, at] + slack), pa.array([name == "near"] * len(row))], names=["q", "qv", "cell", "part", "bound", "near"])

    shape = "q long, qv array<double>, cell int, part int, bound double, near boolean"
    count = F.broadcast(spark.createDataFrame([(int(c), int(p)) for c, p in zip(ids, parts, strict=True)], "cell int, parts int"))
    held = spark.read.schema("c long, cv array<double>, far double, cell int").parquet(f"{path}/vectors").join(count, "cell")
    held = held.select("c", "cv", "cell", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"))
    visits = asked.mapInArrow(first, shape)
    found = visited(visits.where("near"), held, k, digits)
    if exact:
        found = settle(found)
        edge = ranked(found, k).where(F.col("rank") == k).select("q", F.col("score").alias("edge"))
        more = visits.where("not near").join(edge, "q", "left").where(F.col("edge").isNull() | (F.col("bound") >= F.col("edge")))
        found = found.unionByName(visited(more.select("q", "qv", "cell", "part"), held, k, digits))
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visited(visits: DataFrame, held: DataFrame, k: int, digits: int) -> DataFrame:
    """q, c, score: the k best of each visited part of a cell."""

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and own.num_rows:
            order = np.argsort(own["c"].to_numpy(), kind="stable")
            c, v = own["c"].to_numpy()[order], stacked(own["cv"])[order]
            step = max(1, SCORES // len(c))
            for lo in range(0, asked.num_rows, step):
                piece = asked.slice(lo, step)
                best = Best(piece.num_rows, k)
                best.add(c, np.round(stacked(piece["qv"]) @ v.T, digits))
                out.append(pa.RecordBatch.from_arrays([pa.array(np.repeat(piece["q"].to_numpy(), best.id.shape[1])), pa.array(best.id.ravel()), pa.array(best.score.ravel())], schema=NEAR))
        return pa.Table.from_batches(out, NEAR)

    keys = ["cell", "part"]
    # only the folders of visited cells are read
    held = held.join(F.broadcast(visits.select("cell").distinct()), "cell", "left_semi")
    return visits.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "q long, c long, score double")
