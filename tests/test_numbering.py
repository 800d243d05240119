"""Numbers along an order and dense ids, against sorted()."""

import random

from pyspark.sql import functions as F

from wardline.operators.numbering import dense_ids, extended_ids, numbered


def test_numbers_follow_any_order_with_ties_over_several_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice([5, 5, 5, r.randint(-(10**18), 10**18)]), r.choice("abé"), i) for i in range(4000)]
    got = numbered(spark.createDataFrame(rows, "score long, name string, row long").repartition(7), [F.col("score").desc(), F.col("name").asc()], "rank").collect()
    assert sorted(x["rank"] for x in got) == list(range(1, 4001))
    want = sorted((-s, n) for s, n, _ in rows)
    assert [(-x["score"], x["name"]) for x in sorted(got, key=lambda x: x["rank"])] == want
    assert sorted((x["score"], x["name"], x["row"]) for x in got) == sorted(rows)


def test_a_group_of_ties_does_not_meet_in_one_task(spark):
    rows = spark.range(8000).select(F.lit(1).alias("same"), "id")
    ranked = numbered(rows, [F.col("same")], "n")
    sizes = [n for n in ranked.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert len(sizes) >= 3 and max(sizes) < 4000


def test_ids_of_strings_and_hashes(spark):
    r = random.Random(5)
    hashes = [r.randint(-(2**63), 2**63 - 1) for _ in range(3000)]
    ids = dense_ids(spark.createDataFrame([(h,) for h in hashes * 2], "k long"), "k", "id").collect()
    assert {x.k: x.id for x in ids} == {h: n for n, h in enumerate(sorted(hashes))}
    names = ["b", "a", "", "ü", None, "a"]
    ids = dense_ids(spark.createDataFrame([(n,) for n in names], "k string"), "k", "id").collect()
    assert {x.k: x.id for x in ids} == {"": 0, "a": 1, "b": 2, "ü": 3}
    assert dense_ids(spark.createDataFrame([], "k string"), "k", "id").collect() == []


def test_known_ids_stay(spark):
    known = spark.createDataFrame([("m", 0), ("z", 1)], "k string, id long")
    got = extended_ids(known, spark.createDataFrame([("z",), ("b",), ("a",), ("b",)], "k string"), "k", "id")
    assert sorted((x.id, x.k) for x in got.collect()) == [(0, "m"), (1, "z"), (2, "a"), (3, "b")]
    empty = extended_ids(known.limit(0), spark.createDataFrame([("q",)], "k string"), "k", "id")
    assert [tuple(x) for x in empty.collect()] == [("q", 0)]
