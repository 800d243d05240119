"""Tables between steps are planned by the size that they have."""

from pyspark.sql import functions as F

from wardline.operators import sampling
from wardline.sources.shared import stored


def planned_bytes(rows) -> int:
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_stored_rows_are_planned_by_their_files(spark):
    rows = spark.range(4).select("id", F.explode(F.sequence(F.lit(0), F.lit(99_999))).alias("t"))
    found = stored(rows)
    assert found.count() == 400_000 and found.dtypes == rows.dtypes and planned_bytes(found) > 10_000 > planned_bytes(rows)
    assert stored(rows.where("t < 0")).count() == 0


def test_draws_are_never_planned_as_a_small_table(spark):
    """500 users of 100 draws each: their rows must not pass for those of 500 users, which are sent whole through the driver."""
    users = spark.range(500).withColumnRenamed("id", "u")
    items = spark.range(5000).withColumnRenamed("id", "i")
    seen = users.select("u", (F.col("u") * 7 % 5000).alias("i"))
    got = sampling.negatives(users, items, seen, 100, 1)
    assert got.count() == 50_000
    assert "Scan parquet" in got._jdf.queryExecution().executedPlan().toString()
    leaves = got._jdf.queryExecution().optimizedPlan().collectLeaves()
    drawn = [leaves.apply(k) for k in range(leaves.size()) if "place" in leaves.apply(k).output().toString()]
    assert drawn and all(int(str(x.stats().sizeInBytes())) > 100_000 for x in drawn)


def exchanged_below(rows, name: str) -> bool:
    """Whether a shuffle stands below the plan's explode of the column."""
    plan = str(rows._jdf.queryExecution().executedPlan().toString()).split("\n")
    at = next(k for k, line in enumerate(plan) if "Generate explode" in line and name in line)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    below = []
    for line in plan[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    return any("Exchange hashpartitioning" in line for line in below)


def test_users_are_dealt_before_they_become_many_rows(spark):
    from wardline.plans import building, evaluation

    small = "/root/testdata/sf0.001"
    assert exchanged_below(evaluation.predictions(spark, small), "rank")
    assert exchanged_below(building.merging(spark, small)[1], "n#")


def test_histories_are_shuffled_once_for_all_repeats(spark):
    rows = spark.range(300).select((F.col("id") % 30).alias("u"), F.col("id").alias("i"))
    plan = str(sampling.shuffled_histories(rows, 20, 1)._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_a_rating_line_is_taken_apart_once(spark, tmp_path):
    """No filter on the ids stands below the parse, where it would parse the line again."""
    from wardline.sources.readers import ratings

    (tmp_path / "r.txt").write_text("1::2::5\n 3\t4\t2\t9 \n-1,2\nu,i\n\n7 8\n")
    rows = ratings(spark, str(tmp_path / "r.txt"))
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, 2, 5.0, None), (3, 4, 2.0, 9), (7, 8, None, None)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Filter" not in plan[plan.index("Generate") :]
