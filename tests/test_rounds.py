"""Pairs of a cell that are trained in rounds: the factors of one batch after another."""

import numpy as np
import pytest

from wardline.operators import factor_training as ft
from wardline.operators.factor_training import Known, Plan, cell_steps, packed, rounds, start_vectors, unpacked


@pytest.mark.parametrize("hot", [0, 300])
def test_rounds_keep_the_order_of_the_batches(hot):
    r = np.random.default_rng(1)
    touched, batch = np.stack([r.integers(0, 700, 900), 700 + r.integers(0, 900, 900), 700 + r.integers(0, 900, 900)], 1), np.arange(900) // 8
    touched[r.choice(900, hot, False), 1] = 701  # an item that nearly all batches have
    found = list(rounds(touched, batch, np.zeros(1600, np.int64)))
    assert sorted(np.concatenate(found)) == list(range(900)) and (hot or len(found) < 30)
    at = np.empty(900, np.int64)
    for n, x in enumerate(found):
        at[x] = n
    for f in range(1600):
        rows = np.flatnonzero((touched == f).any(1))
        own = sorted({(batch[x], at[x]) for x in rows})
        assert [x for x, _ in own] == sorted({batch[x] for x in rows}) and all(a[1] < b[1] for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize(("loss", "negatives"), [("bpr", 1), ("bpr", 2), ("bce", 2), ("labels", 0)])
def test_rounds_give_the_factors_of_single_batches(monkeypatch, loss, negatives):
    r = np.random.default_rng(2)
    plan = Plan(size=4, loss=loss, negatives=negatives, batch=16)
    users, items = np.arange(6000) * 3, np.arange(9000) * 2
    codes = np.unique(r.integers(0, 6000 * 9000, 20_000))
    u, i = np.divmod(codes, 9000)
    many, steps = [], ft.train_rows
    monkeypatch.setattr(ft, "train_rows", lambda *x: (many.append(len(x[3])), steps(*x))[1])
    got = []
    for least in (8, 10**9):
        monkeypatch.setattr(ft, "ROUNDS_FROM", least)
        p, q = (np.concatenate([start_vectors(1, k, ids, 4, 0.1), np.zeros((len(ids), 1))], 1) for k, ids in ((0, users), (1, items)))
        many.clear()
        cell_steps(plan, 1, u, i, (u + i) % 2 * 1.0, p, q, users, items)
        got.append((p, q, np.mean(many)))
    assert (got[0][0] == got[1][0]).all() and (got[0][1] == got[1][1]).all()
    assert got[0][2] > 2 * got[1][2]


def test_known_codes_are_all_found():
    codes = np.sort(np.random.default_rng(3).choice(10**9, 5000, False))
    asked = np.append(codes, codes + 1)
    assert (Known(codes).has(asked) == np.isin(asked, codes)).all()


def test_cells_move_as_bytes(spark, monkeypatch):
    monkeypatch.setattr(ft, "PACKED", 7)
    rows = [(u, i, float(u == i), u % 2, i % 3) for u in range(9) for i in range(6)]
    found = packed(spark.createDataFrame(rows, "u long, i long, label double, ub int, ib int")).toArrow()
    got = []
    for k in range(found.num_rows):
        got += [(*x, found["ub"][k].as_py(), found["ib"][k].as_py()) for x in zip(*unpacked(found["pairs"].slice(k, 1)), strict=True)]
    assert sorted(got) == rows
