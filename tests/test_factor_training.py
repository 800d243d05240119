"""Blocked factor training: slopes, disjoint cells, equal runs, and what it learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import factor_training as ft
from wardline.operators.factor_training import Plan, block_of, cell_steps, negatives_of, scores, sides, start_vectors, train_factors
from wardline.operators.metrics import per_user
from wardline.operators.ranking import block_lists, rank_catalogue
from wardline.operators.scoring import dot_scorer


def tastes(users=120, items=60, each=10, seed=1):
    """Users of three tastes: nearly all their items come from a third of the catalogue, whose parts are equally popular."""
    r = np.random.default_rng(seed)
    pairs = set()
    for u in range(users):
        for _ in range(each):
            pairs.add((u, int(r.integers(items // 3) * 3 + u % 3) if r.random() < 0.95 else int(r.integers(items))))
    return sorted(pairs)


@pytest.mark.parametrize("loss", ["bpr", "bce", "labels"])
def test_a_step_goes_down_the_loss(loss):
    """One small step over one batch lowers the loss about as its squared slope says."""
    plan = Plan(size=3, loss=loss, negatives=2, rate=1e-4, decay=0.0, batch=1000)
    r = np.random.default_rng(2)
    users, items = np.arange(6), np.arange(9)
    u, i = np.array([0, 1, 2, 3, 4, 5, 0]), np.array([1, 2, 3, 4, 5, 6, 7])
    label = r.integers(0, 2, 7).astype(float)
    p, q = r.normal(size=(6, 4)), r.normal(size=(9, 4))
    before = cell_steps(plan, 1, u, i, label, p, q, users, items)
    p2, q2 = p.copy(), q.copy()
    after = cell_steps(plan, 1, u, i, label, p2, q2, users, items)
    p3, q3 = p.copy(), q.copy()
    assert after < before and (p2 != p).any()
    # the slope in one entry, by differences
    loss_at = lambda a, b: cell_steps(Plan(size=3, loss=loss, negatives=2, rate=0.0, decay=0.0, batch=1000), 1, u, i, label, a, b, users, items)
    for (row, column) in ((0, 0), (3, 2), (5, 3)):
        p3[row, column] += 1e-6
        up = loss_at(p3, q3)
        p3[row, column] -= 2e-6
        slope = (up - loss_at(p3, q3)) / 2e-6
        p3[row, column] += 1e-6
        assert abs((p2 - p)[row, column] / -1e-4 - slope) < 1e-3 * max(1, abs(slope))


def test_negatives_are_not_the_users_own():
    users, items = np.arange(3), np.arange(40)
    u, i = np.repeat(users, 20), np.tile(np.arange(20), 3)
    known = np.unique(u * 40 + i)
    drawn = negatives_of(Plan(negatives=4), 1, u, i, users, items, known)
    assert drawn.shape == (60, 4) and (drawn >= 20).mean() > 0.97
    assert (drawn == negatives_of(Plan(negatives=4), 1, u, i, users, items, known)).all() and (drawn != negatives_of(Plan(negatives=4), 2, u, i, users, items, known)).any()


def test_start_values_are_normal_and_of_the_id():
    x = start_vectors(1, 0, np.arange(5000), 8, 0.1)
    assert abs(x.mean()) < 0.002 and abs(x.std() - 0.1) < 0.002
    assert (x[7] == start_vectors(1, 0, np.array([7]), 8, 0.1)[0]).all() and (x[7] != start_vectors(1, 1, np.array([7]), 8, 0.1)[0]).any()


def collected(factors):
    return {(r["kind"], r["id"]): np.array(r["vector"]) for r in factors.collect()}


def test_an_epoch_equals_the_cells_one_after_another(spark):
    pairs, plan, blocks = tastes(), Plan(size=4, negatives=2, seed=3), 3
    df = spark.createDataFrame(pairs, "u long, i long")
    got = collected(train_factors(df.unionByName(df.limit(50)).repartition(5), plan, 2, blocks)[0])
    ub = {r["u"]: r["b"] for r in df.select("u", block_of("u", blocks).alias("b")).distinct().collect()}
    ib = {r["i"]: r["b"] for r in df.select("i", block_of("i", blocks).alias("b")).distinct().collect()}
    vectors = {(k, i): np.append(start_vectors(3, k, np.array([i]), 4, plan.spread)[0], 0.0) for k, ids in ((0, ub), (1, ib)) for i in ids}
    for epoch in (1, 2):
        for d in range(blocks):
            for b in range(blocks):
                users, items = (np.array(sorted(x for x, y in of.items() if y == c)) for of, c in ((ub, b), (ib, (b + d + epoch) % blocks)))
                own = [(u, i) for u, i in pairs if ub[u] == b and ib[i] == (b + d + epoch) % blocks]
                if own:
                    p, q = np.stack([vectors[0, u] for u in users]), np.stack([vectors[1, i] for i in items])
                    u, i = (np.array(x) for x in zip(*own, strict=True))
                    cell_steps(plan, epoch, np.searchsorted(users, u), np.searchsorted(items, i), np.ones(len(u)), p, q, users, items)
                    vectors |= {(0, x): v for x, v in zip(users.tolist(), p, strict=True)} | {(1, x): v for x, v in zip(items.tolist(), q, strict=True)}
    assert got.keys() == vectors.keys() and all(np.allclose(got[k], vectors[k], atol=1e-12) for k in got)


@pytest.mark.parametrize("loss", ["bpr", "bce"])
def test_it_beats_popularity_on_held_out_items(spark, loss):
    pairs = tastes(users=150, each=12)
    r = np.random.default_rng(5)
    held = {u: i for u, i in sorted(pairs, key=lambda _: r.random()) if i % 3 == u % 3}
    train = spark.createDataFrame([x for x in pairs if held.get(x[0]) != x[1]], "u long, i long")
    valid = spark.createDataFrame(sorted(held.items()), "u long, i long")
    who = block_lists(valid.select("u"), train)

    def ndcg(users, items):
        top = rank_catalogue(who.join(users, "u"), items, dot_scorer(), 10, ["p"]).withColumn("is_minor", F.lit(False))
        return per_user(top, valid, [], (10,)).agg(F.sum("ndcg")).first()[0] / len(held)

    factors, log = train_factors(train, Plan(size=8, loss=loss, negatives=2, rate=0.1), 8, 2, ndcg, 4)
    popular = train.groupBy("i").count().select("i", F.array(F.col("count").cast("double")).alias("q"))
    assert [x["epoch"] for x in log] == [4, 8]
    best = max(x["ndcg"] for x in log)
    assert best > 1.5 * ndcg(valid.select("u", F.array(F.lit(1.0)).alias("p")), popular)
    assert abs(ndcg(*sides(factors)) - best) < 1e-9


def test_labels_are_learned(spark):
    rows = [(u, i, float((u % 2) == (i % 2))) for u in range(40) for i in range(30) if (u * 7 + i * 3) % 5]
    factors, _ = train_factors(spark.createDataFrame(rows, "u long, i long, label double"), Plan(size=4, loss="labels", rate=0.2), 12, 2)
    v = collected(factors)
    right = [(scores(v[0, u][None], v[1, i][None])[0] > 0) == ((u % 2) == (i % 2)) for u in range(40) for i in range(30) if not (u * 7 + i * 3) % 5]
    assert np.mean(right) > 0.9


def test_grid_follows_the_pairs(monkeypatch):
    monkeypatch.setattr(ft, "CELL_PAIRS", 100)
    assert [ft.grid_size(n) for n in (0, 100, 401, 10_000)] == [2, 2, 3, 10]


def test_query_trains_both_losses(spark):
    from wardline.plans import scores as plans

    rows = plans.factor_training(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["loss"], r["epoch"]) for r in rows) == [(x, e) for x in ("bce", "bpr") for e in range(1, 5)]
    assert sum(r["is_best"] for r in rows) == 2 and all(0 <= r["ndcg"] <= 1 for r in rows)
