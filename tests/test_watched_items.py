"""Held-out items of many users: searched by classes, with the rows of the whole ranking."""

from wardline.operators import history
from wardline.plans import adapters, inventory

SMALL = "/root/testdata/sf0.001"


def test_valid_and_train_are_those_of_the_split(spark):
    rows = [(u, i, ts) for u, x in {1: [(5, 3), (4, 3), (9, 1)], 2: [(7, 1), (8, 0)], 3: [(1, 9), (2, None), (3, 9), (4, 9), (5, 2)]}.items() for i, ts in x]
    rows = spark.createDataFrame(rows, "u long, i long, ts long")
    split = history.leave_last_two(rows)
    got = {r["u"]: (r["i"], sorted(r["train"])) for r in history.valid_and_train(rows).collect()}
    valid = {r["u"]: r["i"] for r in split.where("split = 'valid'").collect()}
    assert got == {u: (i, sorted(r["i"] for r in split.where(f"split = 'train' and u = {u}").collect())) for u, i in valid.items()} == {1: (4, [9]), 3: (3, [1, 2, 5])}


def test_training_time_metrics_score_no_whole_catalogue(spark, monkeypatch):
    """The classes of the base score are searched; the histories are sorted by no window."""
    asked, rank = [], inventory.rank_catalogue
    monkeypatch.setattr(inventory, "rank_catalogue", lambda users, items, score, *more: (asked.append(score), rank(users, items, score, *more))[1])
    found = inventory.training_time_metrics(spark, SMALL)
    assert asked == [adapters.SCORE_CLASSES[adapters.base_score][1]]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
