"""Places of wanted items and the search for corners against the whole ranking, and how often items are sent."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.operators import ranking, scoring
from wardline.operators.gate_training import Gate
from wardline.plans import scores


def test_places_are_those_of_the_whole_ranking(spark, monkeypatch):
    """Ties, blocked items, pairs far below and unknown items; items in one block and in several."""
    draw = np.random.default_rng(1)
    v = np.round(draw.normal(size=(900, 6)), 1)
    v[300:] = v[draw.integers(0, 100, 600)]
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, q array<double>")
    blocks = [draw.choice(900, 30, replace=False).tolist() for _ in range(20)]
    users = spark.createDataFrame([(u, draw.normal(size=6).tolist(), b) for u, b in enumerate(blocks)], "u long, p array<double>, block array<long>").cache()
    want = {(r["u"], r["i"], r["rank"]) for r in ranking.rank_catalogue(users, items, scoring.dot_scorer(), 10, ["p"]).collect()}
    best = {(u, i) for u, i, _ in want}
    rest = {(u, i) for u in range(20) for i in draw.integers(0, 900, 9).tolist() if i not in blocks[u]} - best
    pairs = spark.createDataFrame([*best, *rest, (3, 5000)], "u long, i long").join(users, "u")
    got = lambda: {tuple(r) for r in ranking.places(pairs, items, scoring.dot_scorer(), 10, ["p"]).collect()}
    assert got() == want
    monkeypatch.setattr(ranking, "FIRST", 1)
    monkeypatch.setattr(ranking, "ITEM_BYTES", 40_000)
    assert got() == want


def test_places_meet_few_items():
    """400 wanted items at hashed places among 50,000: far fewer pairs are scored than the 20,000,000 of the whole ranking."""
    draw = np.random.default_rng(2)
    items = {"i": np.arange(50_000), "q": draw.normal(size=(50_000, 4))}
    users = {"u": np.arange(400), "p": draw.normal(size=(400, 4))}
    ids, seen, dot = draw.integers(0, 50_000, 400), [], scoring.dot_scorer()
    counted = lambda u, x: (seen.append(len(u["p"]) * len(x["i"])), dot(u, x))[1]
    own = (users["p"] * items["q"][ids]).sum(1).round(9)
    ranking.beaten(users, ids, own, np.zeros(401, np.int64), np.zeros(0, np.int64), items, counted, 10)
    assert sum(seen) < 4_000_000


def test_items_are_sent_to_as_few_blocks_of_users_as_keep_the_tasks_busy(spark):
    users = spark.range(50).select(F.col("id").alias("u"), F.array("id").alias("block"))
    items = spark.range(60).withColumnRenamed("id", "i")
    left, right = ranking.meetings(users, items, 4)
    assert right._df.count() == 60 and left._df.count() == 200  # four tasks at once: one block of users is enough


@pytest.mark.parametrize("n", [1, 40, 30_000])
@pytest.mark.parametrize("by", [1.0, 6.0])
def test_corners_give_the_whole_ranking(n, by):
    draw = np.random.default_rng(n)
    gate = Gate(11, 16)
    theta = by * gate.start(1)
    ids = np.sort(draw.choice(3 * n, n, replace=False)).astype(np.int64)
    items = {"i": ids} | {c: draw.integers(0, 2, n).astype(float) for c in ("r17", "rplus", "rx")}
    users = draw.choice(10**6, 30, replace=False)
    blocks = [draw.choice(3 * n, draw.integers(0, min(3 * n, 80)), replace=False).tolist() for _ in users]
    blocks[0] = ids[: n // 2].tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(users), pa.array(blocks, pa.list_(pa.int64())), pa.array(users % 2 == 0)], names=["u", "block", "is_minor"])
    rows = lambda found: sorted(zip(*[sum((b[c].to_pylist() for b in found), []) for c in ("u", "i", "score")], strict=True))
    whole = lambda u, x: np.round(gate.scores(theta, scores.block_inputs(u, x)), 9)
    scored = []
    corner = scores.gate_corner(gate, theta)
    counted = ranking.Corner(corner.levels, corner.modulus, corner.cells, corner.bound, lambda u, x: (scored.append(len(x["i"])), corner.score(u, x))[1])
    got = rows(list(ranking.best_by_corner(batch, *ranking.cornered(items, counted), counted, 10, ["is_minor"])))
    assert got == rows(list(ranking.best_of_batch(batch, items, whole, 10, ["is_minor"])))
    assert n < 30_000 or sum(scored) < 30 * n / 2


def test_pairs_are_looked_up_where_rows_are_made(spark):
    """As out of the rows of the matrix, which no shuffle moves."""
    users = spark.createDataFrame([(u, [float(u), 1.0]) for u in range(5)], "u long, p array<double>")
    items = spark.createDataFrame([(2 * i, [1.0, float(i)]) for i in range(7)], "i long, q array<double>")
    pairs = spark.createDataFrame([(u, i) for u in range(7) for i in (0, 3, 4, 4, 99)], "u long, i long")
    found = scoring.looked_up_in_rows(pairs, users, items, scoring.dot_scorer(), ["p"])
    want = [(u, i, float(u + i // 2) if u < 5 and i in (0, 4) else None) for u in range(7) for i in (0, 3, 4, 4, 99)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "scores" not in found._jdf.queryExecution().executedPlan().toString()
