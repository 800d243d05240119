"""The stored index against a full scan."""

import numpy as np
import pytest

from wardline.operators import vector_index
from wardline.operators.vector_index import build_index, fitted, nearest_centre, search


def clustered(n, seed, dims=6):
    r = np.random.default_rng(seed)
    return np.round(r.normal(size=(12, dims))[r.integers(12, size=n)] * 3 + r.normal(size=(n, dims)), 3)


def scan(queries, vectors, k):
    out = {}
    for q, v in enumerate(queries):
        s = np.round(vectors @ v, 9)
        out[q] = [(int(c), s[c]) for c in sorted(range(len(s)), key=lambda c: (-s[c], c))[:k]]
    return out


def collected(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append((r["c"], r["score"]))
    return out


def as_rows(spark, vectors, names):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{names[0]} long, {names[1]} array<double>")


@pytest.mark.parametrize("part", [50_000, 40])
def test_exact_search_equals_a_scan(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(vector_index, "PART", part)
    vectors, queries = clustered(900, 1), clustered(40, 2)
    vectors[100:180] = vectors[100]  # many equal vectors
    rows = as_rows(spark, vectors, ("c", "cv")).unionByName(spark.createDataFrame([(9999, None)], "c long, cv array<double>"))
    build_index(rows.repartition(5), str(tmp_path / "index"), 15)
    asked = as_rows(spark, queries, ("q", "qv")).repartition(3)
    want = scan(queries, vectors, 10)
    for probes in (1, 4, 50):
        got = collected(search(spark, str(tmp_path / "index"), asked, 10, probes))
        assert got.keys() == want.keys() and all([c for c, _ in got[q]] == [c for c, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)


def test_fast_search_finds_most(spark, tmp_path):
    vectors, queries = clustered(2000, 3), clustered(60, 4)
    build_index(as_rows(spark, vectors, ("c", "cv")), str(tmp_path / "index"), 20)
    got = collected(search(spark, str(tmp_path / "index"), as_rows(spark, queries, ("q", "qv")), 10, 5, exact=False))
    want = scan(queries, vectors, 10)
    assert sum(len({c for c, _ in got[q]} & {c for c, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_few_and_no_vectors(spark, tmp_path):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "c long, cv array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "q long, qv array<double>")
    build_index(one, str(tmp_path / "one"), 8)
    assert [tuple(r) for r in search(spark, str(tmp_path / "one"), asked, 3).collect()] == [(1, 5, 3.0, 1)]
    build_index(one.limit(0), str(tmp_path / "none"), 8)
    assert search(spark, str(tmp_path / "none"), asked, 3).collect() == []


def test_every_cell_has_its_nearest_vectors():
    x = clustered(500, 5)
    centres = fitted(x, 12, 1)
    own, far = nearest_centre(x, centres)
    gaps = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1))
    assert np.allclose(gaps.min(1), far) and (gaps.argmin(1) == own).all() and (np.bincount(own, minlength=12) > 0).all()


def test_recall_of_the_registered_index(spark):
    from wardline.plans.text import indexed_recall

    assert indexed_recall(spark, "/root/testdata/sf0.001").first()["recall"] >= 0.9
