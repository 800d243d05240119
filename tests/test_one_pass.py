"""Queries that make their rows once and sort no more than they need."""

from wardline.operators import build, history
from wardline.plans import building, scores
from wardline.sources import shared

SMALL = "/root/testdata/sf0.001"


def test_place_maps_are_those_of_ranked_rows(spark):
    rows = [(u, i, ts) for u, x in {1: [(5, 3), (4, 3), (9, 1)], 2: [(7, 1), (8, 0)], 3: [(1, 9), (2, None), (3, 9), (4, 9)]}.items() for i, ts in x]
    rows = spark.createDataFrame(rows, "u long, i long, ts long")
    got = {r["u"]: r["ids"] for r in build.place_maps(rows, 3).collect()}
    want = {r["u"]: r["ids"] for r in build.id_maps(history.ranked(rows), "i", "history_rank", "u").where("u <> 2").collect()}
    assert got == want == {1: {9: 1, 4: 2, 5: 3}, 3: {2: 1, 1: 2, 3: 3, 4: 4}}
    assert [list(r["ids"]) for r in build.place_maps(rows, 3).where("u = 1").collect()] == [[4, 5, 9]]


def test_place_maps_sort_no_window(spark):
    assert "Window" not in building.item_place_maps(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_gate_training_makes_its_rows_once(spark, monkeypatch):
    """The pairs are made by one aggregate, and the steps read stored rows."""
    plans, reads = [], []
    monkeypatch.setattr(scores, "stored", lambda rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), shared.stored(rows))[1])
    train = scores.scoring.train_gate
    monkeypatch.setattr(scores.scoring, "train_gate", lambda rows, *more: (reads.append(rows._jdf.queryExecution().optimizedPlan().toString()), train(rows, *more))[1])
    scores.gate_training(spark, SMALL)
    assert len(plans) == 1 and plans[0].count("Aggregate") == 1 and "Join" not in reads[0]
