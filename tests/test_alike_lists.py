"""Votes once for each distinct list, and a curve that is worked out once."""

from pyspark.sql import functions as F

from wardline.operators import calibrate


def voted(ranked, judged):
    """Plain loops over each user's own list."""
    choice = {(m, lo, hi): (f, r) for m, lo, hi, f, r in judged}
    lists = {}
    for u, m, i, rank in ranked:
        lists.setdefault((u, m), []).append((rank, i))
    out = []
    for (u, m), x in lists.items():
        votes = dict.fromkeys([i for _, i in x], 0)
        for a in votes:
            for b in votes:
                if a < b and (m, a, b) in choice:
                    f, r = choice[m, a, b]
                    votes[a] += (f == 0) + (r == 1)
                    votes[b] += (f == 1) + (r == 0)
        order = sorted((votes[i], rank, i) for rank, i in x)
        out += [(u, i, v, place) for place, (v, _, i) in enumerate(order, 1)]
    return sorted(out)


def test_votes_are_those_of_each_list(spark):
    lists = {1: [5, 3, 8], 2: [5, 3, 8], 3: [3, 5, 8], 4: [5, 3, 8], 5: [9], 6: [5, 3]}
    ranked = [(u, u == 4, i, rank) for u, x in lists.items() for rank, i in enumerate(x, 1)]
    judged = [(m, lo, hi, (lo + hi + m) % 3, (lo * hi + m) % 3) for m in (False, True) for lo, hi in ((3, 5), (5, 8), (3, 8))][:-1]
    rows = spark.createDataFrame(ranked, "u long, is_minor boolean, i long, rank int")
    got = calibrate.vote_rerank(rows, spark.createDataFrame(judged, "is_minor boolean, lo long, hi long, choice_fwd int, choice_rev int"))
    assert sorted(map(tuple, got.collect())) == voted(ranked, judged)


def test_equal_lists_are_one_kind(spark):
    """200 users of three lists: three kinds, so that pairs do not grow with the users."""
    users = spark.range(200).withColumnRenamed("id", "u").withColumn("is_minor", F.col("u") % 10 == 0)
    rows = users.withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("i", F.when(F.col("u") == 7, 40).otherwise(10) + F.col("rank"))
    own, kinds = calibrate.alike(rows)
    assert sorted({(r["u"], r["is_minor"]) for r in kinds.collect()}) == [(0, True), (1, False), (7, False)] and kinds.count() == 6
    assert {r["u"]: r["kind"] for r in own.collect()} == {u: 0 if u % 10 == 0 else 7 if u == 7 else 1 for u in range(200)}


def test_a_curve_is_worked_out_once(spark):
    """The choice reads its curve twice, but not what is behind it."""
    ranked = spark.range(40).select((F.col("id") % 4).alias("u"), F.col("id").alias("rank"), (F.col("id") / 40).alias("safety"), (F.col("id") % 3 == 0).cast("int").alias("unsafe"))
    got = calibrate.choose(calibrate.risk_curve(ranked, calibrate.thresholds(spark)), [1.0, 0.0])
    assert [(r["fraction"], r["g"]) for r in got.orderBy("fraction").collect()][0] == (0.0, 100)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
