"""Brute-force and contract tests of the draws, budgets, relevance, losses and the stage runner."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import audit, candidates, history, records, retrieval, sampling, scoring
from wardline.plans import inventory, runner
from wardline.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def cut(parts, budget):
    while parts and sum(map(len, parts)) > budget:
        parts = parts[len(parts) // 8 + 1 :]
    return parts


def test_budget_equals_brute_force(spark):
    draw = random.Random(3)
    lists = [["x" * draw.randrange(60) for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 40, 300)] + [["y" * 5000]]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, p array<string>").select("k", records.within_budget(F.col("p"), 500).alias("p")).collect()
    assert {r["k"]: list(r["p"]) for r in rows} == {k: cut(p, 500) for k, p in enumerate(lists)}


def test_budget_holds_for_a_million_parts(spark):
    long = F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.lpad(i.cast("string"), 20, "0"))
    got = spark.range(1).select(long.alias("p")).select(records.within_budget(F.col("p"), 500).alias("p")).first()["p"]
    assert list(got) == cut([f"{i:020}" for i in range(1, 1_000_001)], 500)


def test_budgeted_history_keeps_the_latest_turns(spark):
    got = inventory.budgeted_history(spark, SMALL).collect()
    assert all(r["n_kept"] <= r["n_turns"] and len(r["text"]) <= 2000 + r["n_kept"] for r in got)


def test_drawn_negatives_are_unseen_and_null_when_all_is_blocked(spark):
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "u long, i long")
    got = sampling.trial_negatives(rows, rows, 5, 3, 10, 1).collect()
    assert all(r["neg"] is None for r in got if r["u"] == 1) and len(got) == 18
    assert all(r["neg"] in (1, 2, 3, 4, None) for r in got if r["u"] == 2)


def test_sample_without_replacement(spark):
    rows = spark.range(30).withColumnRenamed("id", "k")
    assert sampling.sample_n(rows, "k", 7, 1).distinct().count() == 7
    assert sampling.sample_n(rows, "k", 99, 1).count() == sampling.sample_n(rows, "k", -1, 1).count() == 30


def test_strata_are_cut_as_by_a_full_sort(spark, monkeypatch):
    """Repeated rows, a missing stratum, null strata, sizes of nothing and of more than there is."""
    monkeypatch.setattr(sampling, "LEAD", 1)  # so that cuts fall among many rows of equal digits
    rows = [(k % 150, "ab"[k % 2]) for k in range(300)] + [(7, None)]
    df = spark.createDataFrame(rows, "k long, s string")
    order = lambda k: (hashlib.md5(f"5|{k}".encode()).hexdigest(), k)
    for sizes in ({"a": 40, "b": 0}, {"a": 1, "b": 999, "c": 3}, {"a": 75, "b": 150}):
        got = sorted((r["s"], r["k"]) for r in sampling.stratified(df, "k", "s", sizes, 5).collect())
        assert got == sorted((s, k) for s, n in sizes.items() for k in sorted((k for k, x in rows if x == s), key=order)[:n])
    parts = sampling.hash_split(df.select("k"), "k", 0.5, 5).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"calib": 150, "holdout": 151}
    assert sampling.hash_split(df.limit(0), "k", 0.5, 5).count() == 0


def test_shuffles_keep_the_history_whole(spark):
    rows = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 9)], "u long, i long")
    got = sampling.shuffled_histories(rows, 4, 2).collect()
    assert len(got) == 4 and all(sorted([r["target"], *r["rest"]]) == list(range(6)) for r in got)
    assert len({tuple(r["rest"]) for r in got}) > 1


def test_relevance_takes_empty_texts_and_genres(spark):
    users = spark.createDataFrame([(1, "red bolt", ["a"], [3]), (2, None, [], []), (3, "", ["zz"], [])], "u long, text string, genres array<string>, block array<bigint>")
    items = spark.createDataFrame([(1, "red bolt", ["a", "b"]), (2, "blue nut", ["c"]), (3, "red bolt", ["a"]), (4, None, [])], "i long, text string, genres array<string>")
    got = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in candidates.relevance_top(users, items, 2).collect()}
    assert got[1, 1] == (1, pytest.approx(0.75 + 0.125)) and got[1, 2] == (2, 0.0)
    assert got[2, 1] == (1, 0.0) and got[3, 2] == (2, 0.0)


def test_nearest_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    draw = random.Random(1)
    v = {k: [draw.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(3)] for k in range(40)}
    rows = spark.createDataFrame(list(v.items()), "c long, cv array<float>")
    asked = rows.where("c < 11").select(F.col("c").alias("q"), F.col("cv").alias("qv"))
    got = sorted((r["q"], r["rank"], r["c"]) for r in retrieval.nearest(asked, rows, 5).collect())
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    want = [(q, k + 1, c) for q in range(11) for k, c in enumerate(sorted(v, key=lambda c: (-dot(q, c), c))[:5])]
    assert got == sorted(want)
    assert retrieval.nearest(asked.limit(0), rows, 5).count() == 0


def test_losses(spark):
    row = spark.range(1).select(*[v.alias(k) for k, v in scoring.losses(F.lit(0.3), F.lit(-0.2)).items()]).first()
    assert row["bpr"] == pytest.approx(math.log(1 + math.exp(-0.5))) and row["hinge"] == 0
    assert row["bce"] == pytest.approx((math.log(1 + math.exp(-0.3)) + math.log(1 + math.exp(-0.2))) / 2)
    assert spark.range(1).select(scoring.softplus(F.lit(1000.0))).first()[0] == 1000.0


def test_top_values_break_ties_by_value(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (1, "c")], "u long, g string")
    assert [(r["g"], r["rank"]) for r in history.top_values(rows, "u", "g", 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_mean_of_zero_vectors_stays_zero(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "k long, v array<float>")
    got = {(r["k"], r["dim"]): r["x"] for r in retrieval.mean_pool(rows, "k", "v").collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.0, (2, 0): pytest.approx(0.6), (2, 1): pytest.approx(0.8)}


def test_stages_skip_force_and_check(spark, tmp_path):
    out = f"file://{tmp_path}/a"
    stages = [runner.Stage("a", out, lambda s: s.range(3)), runner.Stage("b", f"file://{tmp_path}/b", lambda s: s.read.parquet(out), (out,))]
    with pytest.raises(FileNotFoundError):
        runner.run_stages(spark, stages, only={"b"})
    with pytest.raises(ValueError, match="no such stage: z"):
        runner.run_stages(spark, stages, only={"z"})
    assert runner.run_stages(spark, stages, dry_run=True) == [("a", "planned"), ("b", "planned")]
    assert runner.run_stages(spark, stages) == [("a", "ran"), ("b", "ran")]
    assert runner.run_stages(spark, stages) == [("a", "skipped"), ("b", "skipped")]
    assert runner.run_stages(spark, stages, only={"b"}, force=True) == [("b", "ran")]


def test_best_epoch(spark):
    log = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.5), (4, None)], "epoch long, hr double")
    assert tuple(runner.best_epoch(log, "hr").first()) == (2, 0.5)


def test_sessions_run_as_a_stream(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = incremental.event_sessions(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done, whole = spark.read.parquet(str(tmp_path / "out")), incremental.event_sessions(spark.read.parquet(str(tmp_path / "in")))
    assert 0 < done.count() <= whole.count() and done.exceptAll(whole.select(done.columns)).count() == 0


def test_pool_leaks_counts_own_negatives_and_wrong_heads(spark):
    split = spark.createDataFrame([(u, i, s, t) for u in (1, 2, 3, 4) for i, s, t in ((10, "train", 1), (20, "valid", 2), (30, "test", 3))], "u long, i long, split string, ts long")
    pool = lambda rows: spark.createDataFrame([(u, p, k, i) for u, p, negs in rows for k, i in enumerate([p, *negs])], "u long, pos long, place long, i long")
    # user 1 has own test and train items as valid negatives, 2 another head, 3 no valid pool; user 4 a test negative of valid
    valid, test = pool([(1, 20, [30, 10, 5]), (2, 21, [6]), (4, 20, [7])]), pool([(u, 30, [20 if u == 4 else 8]) for u in (1, 2, 3, 4)])
    got = {r["check"]: r["n"] for r in audit.pool_leaks(split, {"valid": valid, "test": test}).collect()}
    assert got == {"valid_negative_leak": 1, "valid_head_mismatch": 2, "test_negative_leak": 1, "test_head_mismatch": 0}


def test_strict_balance_takes_the_smallest_quadrant_of_each(spark):
    have = {"like_safe": 30, "like_unsafe": 4, "dislike_safe": 11, "dislike_unsafe": 9}
    rows = spark.createDataFrame([(u, n, q) for n, (q, k) in enumerate(have.items()) for u in range(k)], "u long, i long, quadrant string")
    got = [r["quadrant"] for r in sampling.strictly_balanced(rows, 3).collect()]
    assert {q: got.count(q) for q in have} == dict.fromkeys(have, 4) and len(got) == 16
    assert sampling.strictly_balanced(rows.where("quadrant != 'like_unsafe'"), 3).count() == 0


def test_a_blocked_row_still_gets_its_negative(spark):
    """All but a few items are seen, so the trials fail; what is left is drawn exactly."""
    seen = sorted(set(range(500)) - {3, 250, 499})
    old = [(u, i) for u, own in ((1, seen), (2, range(500)), (3, [*seen, 3, 250, 9999])) for i in own]
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "u long, i long")
    got = sampling.trial_negatives(rows, spark.createDataFrame(old, "u long, i long"), 500, 40, 2, 5).select("u", "neg").collect()
    assert {r["neg"] for r in got if r["u"] == 1} == {3, 250, 499}
    assert {r["neg"] for r in got if r["u"] == 2} == {None} and {r["neg"] for r in got if r["u"] == 3} == {499}


def test_negatives_by_draws_and_for_the_nearly_blocked(spark):
    items = spark.range(400).select((F.col("id") * 7 + 3).alias("i"))
    ids = [7 * k + 3 for k in range(400)]
    blocks = {1: [], 2: ids[:200], 3: ids[:395], 4: ids}
    users = spark.createDataFrame([(u,) for u in blocks], "u long")
    seen = spark.createDataFrame([(u, i) for u, own in blocks.items() for i in own], "u long, i long")
    want = {}
    for u, block in ((1, []), (2, ids[:200]), (3, ids[:395]), (4, ids)):
        at = lambda t, u=u: int(hashlib.md5(f"5|{u}|{t}".encode()).hexdigest()[:12], 16) % 400
        free = list(dict.fromkeys(i for i in (ids[at(t)] for t in range(sampling.DRAWS * 20)) if i not in block))
        rest = [i for i in [*ids[at(-1) :], *ids[: at(-1)]] if i not in block and i not in free]
        want[u] = [*free, *rest][:20]
    got = {}
    for r in sorted(sampling.negatives(users, items, seen, 20, 5).collect(), key=lambda r: (r["u"], r["place"])):
        got.setdefault(r["u"], []).append(r["i"])
    assert got == {u: x for u, x in want.items() if x}


def test_a_long_history_in_a_large_catalogue(spark):
    """100,000 seen items of one user, ten million items: no row holds either."""
    items = spark.range(10_000_000).withColumnRenamed("id", "i")
    seen = spark.range(100_000).select(F.lit(1).cast("long").alias("u"), (F.col("id") * 7).alias("i"))
    users = spark.createDataFrame([(1,), (2,)], "u long")
    got = sampling.negatives(users, items, seen, 30, 5).collect()
    assert sorted((r["u"], r["place"]) for r in got) == [(u, p) for u in (1, 2) for p in range(1, 31)]
    assert all(r["u"] == 2 or r["i"] % 7 or r["i"] >= 700_000 for r in got)
    rows = seen.where("i < 70000")
    drawn = sampling.trial_negatives(rows, seen, 10_000_000, 1, 3, 4)
    assert drawn.count() == rows.count() and drawn.where("neg is null or (neg % 7 = 0 and neg < 700000)").count() == 0


def test_long_pool_lines_keep_their_tail(spark):
    from wardline.sources.readers import pool_lines

    n = 1_000_003
    line = spark.range(1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i.cast("string"))).alias("value"))
    assert pool_lines(line).agg(F.count("*"), F.max("i")).first()[:] == (n, n)


def test_fingerprints_tell_repeated_rows_apart(spark):
    from wardline.sources.writers import fingerprint

    of = lambda rows: fingerprint(spark.createDataFrame(rows, "x string, y string")).first()
    assert of([("a", None), ("a", None)]) != of([("b", None), ("b", None)])
    assert of([("a", None)]) != of([(None, "a")]) and of([("a", "b"), ("c", "d")]) == of([("c", "d"), ("a", "b")])


def test_bootstrap_of_2000_replicas_equals_brute_force(spark):
    import numpy as np

    values = {u: (u * 37 % 11) / 10 for u in range(60)}
    steps, means = audit.poisson_steps(), []
    for r in range(2000):
        w = {u: sum((int(hashlib.md5(f"7|{u}|{r // 4}".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8], 16) + 0.5) / 2**32 > t for t in steps) for u in values}
        means.append(sum(w[u] * x for u, x in values.items()) / max(1, sum(w.values())))
    got = audit.bootstrap(spark.createDataFrame(list(values.items()), "u long, v double"), "v").first()
    assert np.allclose([got["low"], got["high"], got["mean"]], [*np.quantile(means, [0.025, 0.975]), np.mean(list(values.values()))])


def test_the_best_of_many_pieces_are_the_best_of_all():
    import numpy as np

    r = np.random.default_rng(3)
    scores, ids = r.integers(0, 9, (4, 500)) / 9.0, r.permutation(500)
    best = retrieval.Best(4, 7)
    for lo in range(0, 500, 23):
        order = np.argsort(ids[lo : lo + 23])
        best.add(ids[lo : lo + 23][order], scores[:, lo : lo + 23][:, order])
    for q in range(4):
        assert list(zip(-best.score[q], best.id[q])) == sorted(zip(-scores[q], ids))[:7]


def test_catalogues_are_cut_by_their_bytes(spark, monkeypatch):
    from wardline.operators import ranking

    users = spark.createDataFrame([(1, [5]), (2, [])], "u long, block array<bigint>")
    items = spark.range(40).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k.cast("double")).alias("v"))
    score = lambda rows, columns: np.stack(columns["v"]).sum(1)[None, :] * 0 + (columns["i"][None, :] * 7 % 40)
    import numpy as np

    want = sorted(ranking.rank_catalogue(users, items, score, 6).collect())
    monkeypatch.setattr(ranking, "ITEM_BYTES", 900)
    assert sorted(ranking.rank_catalogue(users, items, score, 6).collect()) == want and len(want) == 12
