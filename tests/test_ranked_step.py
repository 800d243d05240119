"""The ranking step that full-catalogue queries share: one shuffle of the users, no sort of what is ranked."""

import numpy as np
from pyspark.sql import functions as F

from wardline.operators import audit, calibrate, history, metrics
from wardline.operators.ranking import Classes, rank_catalogue
from wardline.plans import adapters as A
from wardline.plans.evaluation import safety_ranked

SF = "/root/testdata/sf0.001"


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_one_block_is_ranked_where_it_is_found(spark):
    users = spark.createDataFrame([(7, True, [2]), (3, False, []), (9, None, [1, 4])], "u long, m boolean, block array<long>")
    items = spark.createDataFrame([(i, i % 2) for i in (4, 1, 3, 2)], "i long, class long")
    tied = lambda u, x: np.zeros((len(u["u"]), len(x["i"])))
    by = Classes("class", tied, lambda level, u, x: level, lambda level, x: level)
    for score in (tied, by):
        top = rank_catalogue(users, items, score, 3)
        assert "Window" not in plan(top)
        got = sorted(top.select("u", "i", "rank", "m").collect())
        assert [tuple(r) for r in got] == [(3, 1, 1, False), (3, 2, 2, False), (3, 3, 3, False), (7, 1, 1, True), (7, 3, 2, True), (7, 4, 3, True), (9, 2, 1, None), (9, 3, 2, None)]


def test_kept_columns_and_ranks_of_several_blocks(spark, monkeypatch):
    users = A.users(spark, SF).where("u % 5 = 0").withColumn("block", F.array(F.col("u") % 7))
    items = A.items(spark, SF).select("i")
    rows = lambda: sorted(map(tuple, rank_catalogue(users, items, A.base_score, 6).select("u", "i", "score", "rank", "is_minor").collect()))
    want = rows()
    monkeypatch.setattr("wardline.operators.ranking.ITEM_BLOCK", 90)
    assert rows() == want and len(want) == 6 * users.count()


def test_last_and_rest_are_the_split(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 6, 3), (1, 4, 3), (1, 8, 2), (2, 1, 1), (2, 2, 2), (3, 9, 5), (3, 8, 5), (3, 7, 5)], "u long, i long, ts long")
    split = history.leave_last_two(rows)
    want = {r["u"]: (r["i"], set()) for r in split.where("split = 'test'").collect()}
    for r in split.where("split <> 'test'").collect():
        want[r["u"]][1].add(r["i"])
    found = history.last_and_rest(rows)
    assert {r["u"]: (r["i"], set(r["rest"])) for r in found.collect()} == want and set(want) == {1, 3}
    assert "Window" not in plan(found)


def test_positives_meet_rows_once_by_user(spark):
    ranked = spark.createDataFrame([(1, 7, 1, True), (1, 8, 2, True), (2, 7, 1, False), (3, 7, 1, False)], "u long, i long, rank int, is_minor boolean")
    pos = spark.createDataFrame([(1, 8), (1, 8), (1, None), (2, 9)], "u long, i long")
    got = {r["u"]: (r["hit"], round(r["ndcg"], 6)) for r in metrics.per_user(ranked, pos, [], [5]).collect()}
    gain = 1 / np.log2(3)
    assert got == {1: (1, round(gain / (1 + gain), 6)), 2: (0, 0.0)}
    assert plan(metrics.per_user(ranked, pos, [], [5])).count("Join") == 1


def test_curve_with_history_reads_the_ranking_once(spark):
    rows = [(u, i, 1.0 - i / 10, (u * i) % 7 / 7, i % 2, i + 1) for u in (1, 2, 3) for i in range(4)]
    ranked = spark.createDataFrame(rows, "u long, i long, score double, safety double, unsafe int, rank int")
    past = spark.createDataFrame([(1, 2, 0.95, 0), (1, 77, 0.75, 0), (9, 5, 0.5, 0)], "u long, i long, score double, unsafe int")
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    curve = calibrate.risk_curve(ranked.mapInArrow(seen, ranked.schema), calibrate.thresholds(spark, 10), past)
    got = {r["g"]: (round(r["raw"], 6), r["n"]) for r in curve.collect()}
    assert runs.value == len(rows)
    for g in range(11):
        gamma = g / 9 if g < 10 else 1.1
        flags = [[x[4] for x in rows if x[0] == u and x[3] >= gamma and (u, x[1]) != (1, 2)] for u in (1, 2, 3)]
        assert got[g] == (round(sum(map(sum, flags)) / 20 / 3, 6), 3)


def test_selection_with_history_moves_rows_once(spark):
    ranked = spark.createDataFrame([(1, 5, 0.5, 0.9), (1, 6, 0.4, 0.1), (2, 5, 0.7, 0.8)], "u long, i long, score double, safety double")
    past = spark.createDataFrame([(1, 5, 0.5), (1, 9, 0.6), (1, 2, 0.5), (4, 1, 0.2)], "u long, i long, score double")
    found = calibrate.select_safe(ranked, 0.3, past)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2), (1, 5, 3), (1, 9, 1), (2, 5, 1), (4, 1, 1)]
    assert plan(calibrate.select_safe(ranked, 0.3, past)).count("Exchange hashpartitioning") == 1


def test_faults_are_counted_in_one_reading(spark):
    rows = spark.createDataFrame([(3, 2, 5), (1, 2, 1), (1, 1, 1)], "sex long, unsafe_any long, slots long")
    found = audit.exposure_faults(rows, ["sex"], "unsafe_any")
    assert plan(found).count("ExistingRDD") == 1
    assert sorted(map(tuple, found.collect())) == [("part_over_whole", 1), ("whole_over_slots", 1)]


def test_selections_and_curves_sort_only_what_they_place(spark):
    ranked = safety_ranked(spark, SF)
    logical = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in logical(calibrate.risk_curve(ranked, calibrate.thresholds(spark)))
    assert "back#" not in logical(calibrate.select_safe(ranked, 0.3)) and "rank#" not in logical(calibrate.select_safe(ranked, 0.3)).split("MapInArrow")[0]
