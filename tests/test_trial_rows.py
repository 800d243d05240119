"""Drawn negatives in the user's row: the rows of the join, and no draw shuffled."""

from wardline.operators import sampling


def test_draws_of_a_row_are_those_of_the_join(spark, monkeypatch):
    rows = [(u, i) for u in range(1, 9) for i in range(0, 3 * u, 2)]
    seen = [(u, i) for u in range(2, 9) for i in range(0, 3 * u - 4)] + [(9, i) for i in range(20)] + [(3, -4), (3, 99), (3, 1), (8, None)] + [(7, i) for i in range(20)]
    rows, seen = spark.createDataFrame(rows, "u long, i long"), spark.createDataFrame(seen, "u long, i long")
    known = seen.selectExpr("u", "i x").where("x between 0 and 19").distinct()
    for trials in (1, 2, 5):
        want = sorted(map(tuple, sampling.joined_trials(rows, known, 20, 3, trials, 4).collect()), key=str)
        for most in (4096, 9, 0):  # of some, and of all users the histories are too long for a row
            monkeypatch.setattr(sampling, "HISTORY", most)
            found = sampling.trial_negatives(rows, seen, 20, 3, trials, 4)
            assert sorted(map(tuple, found.collect()), key=str) == want and len(want) == 3 * rows.count()
    assert {r[3] for r in want if r[0] == 7} == {None}


def test_only_pairs_are_shuffled(spark):
    rows = spark.range(50).selectExpr("id % 5 u", "id i")
    found = sampling.trial_negatives(rows, rows, 1000, 4, 8, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[plan.index("Exchange") :] and found.count() == 200


def test_no_items(spark):
    rows = spark.createDataFrame([(1, 2)], "u long, i long")
    assert [tuple(r) for r in sampling.trial_negatives(rows, rows, 0, 2, 3, 1).collect()] == [(1, 2, 0, None), (1, 2, 1, None)]
