"""The calibration curve and vector propagation against plain loops."""

import random

import numpy as np

from wardline.operators import scoring
from wardline.operators.calibrate import list_curves, risk_curve, thresholds


def plain_curve(items, gammas, slots=20):
    """items in order: (safety or None for always, unsafe)."""
    out = []
    for g in gammas:
        taken = [u for s, u in items if s is None or s >= g][:slots]
        out.append(sum(taken) / slots)
    return out


def test_stretches_of_thresholds_equal_a_list_for_each():
    r = random.Random(2)
    gammas = [x / 7 for x in range(8)] + [1.1]
    lists = [[(None if r.random() < 0.2 else r.choice([0, 0.3, 1, r.random()]), r.randint(0, 1)) for _ in range(r.choice([0, 1, 5, 30, 90]))] for _ in range(60)]
    flat = [x for own in lists for x in own]
    level = np.array([len(gammas) if s is None else sum(g <= s for g in gammas) for s, _ in flat])
    for slots in (1, 3, 20):
        got = list_curves(np.append(0, np.cumsum([len(x) for x in lists])), level, np.array([float(u) for _, u in flat]), len(gammas), slots)
        assert np.allclose(got, [plain_curve(own, gammas, slots) for own in lists])


def test_curve_with_history(spark):
    r = random.Random(3)
    ranked = [(u, i, r.choice([0.1, 0.5, r.random()]), r.random(), r.randint(0, 1)) for u in range(30) for i in r.sample(range(200), 50)]
    past = [(u, i, r.choice([0.1, 0.5, r.random()]), 0) for u in range(32) for i in r.sample(range(200), 10)]
    rows = []
    for u in range(30):
        own = sorted((x for x in ranked if x[0] == u), key=lambda x: (-x[2], x[1]))
        rows += [(*x, n) for n, x in enumerate(own, 1)]
    ranked_df = spark.createDataFrame(rows, "u long, i long, score double, safety double, unsafe int, rank int")
    grid = thresholds(spark, 11)
    gammas = [x["gamma"] for x in sorted(grid.collect())]
    for history in (None, past):
        curves = []
        for u in range(30):
            old = {i: s for v, i, s, _ in past if v == u} if history else {}
            merged = [(-s, i, safety, unsafe) for v, i, s, safety, unsafe in ranked if v == u and i not in old] + [(-s, i, None, 0) for i, s in old.items()]
            curves.append(plain_curve([(s, f) for _, _, s, f in sorted(merged, key=lambda x: x[:2])], gammas))
        want, top = np.mean(curves, 0), np.mean(np.maximum.accumulate(np.array(curves)[:, ::-1], 1)[:, ::-1], 0)
        got = sorted(risk_curve(ranked_df, grid, None if history is None else spark.createDataFrame(past, "u long, i long, score double, unsafe int")).collect())
        assert np.allclose([x["raw"] for x in got], want) and np.allclose([x["envelope"] for x in got], top)
        assert np.allclose([x["adjusted"] for x in got], (30 * top + 1) / 31)


def test_vectors_propagate_as_their_dimensions(spark):
    r = random.Random(4)
    pairs = sorted({(f"u{r.randint(0, 9)}", f"i{r.randint(0, 12)}") for _ in range(60)})
    names = sorted({x for p in pairs for x in p})
    x = {n: [r.uniform(-1, 1) for _ in range(5)] for n in names}
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a string, b string")
    got = {row["node"]: row["x"] for row in scoring.propagate_vectors(edges, spark.createDataFrame(list(x.items()), "node string, x array<double>"), 3).collect()}
    a = np.zeros((len(names), len(names)))
    for p, q in pairs:
        a[names.index(p), names.index(q)] = a[names.index(q), names.index(p)] = 1
    d = a.sum(1) ** -0.5
    a, layer = a * d[:, None] * d[None, :], np.array([x[n] for n in names])
    total = layer.copy()
    for _ in range(3):
        layer = a @ layer
        total += layer
    assert np.allclose([got[n] for n in names], total / 4)


def test_safety_is_learned_from_ids(spark):
    """Minors may not see odd items; no feature but ids says so."""
    r = random.Random(5)
    rows = [(u, i, u % 5 == 0, int(not (u % 5 == 0 and i % 2))) for u in range(60) for i in r.sample(range(40), 20)]
    df = spark.createDataFrame(rows, "u long, i long, is_minor boolean, safe int")
    model = scoring.learned_safety(df.where("(u + i) % 4 <> 0"), "safe", 1 << 12)
    held = model.transform(df.where("(u + i) % 4 = 0")).select("safe", "prediction").collect()
    assert sum(x["safe"] == x["prediction"] for x in held) > 0.95 * len(held)
