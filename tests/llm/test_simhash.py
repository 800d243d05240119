import random
import re

import numpy as np
import xxhash

from tests.llm.helpers import frame
from wardline.llm import simhash
from wardline.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def brute_groups(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_against_brute_force(spark):
    r = random.Random(3)
    words = [f"W{i}é" for i in range(300)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(6)]
    texts = [None, "", " \n", "One", "one", "a b c", "A  b\tc"]
    for i in range(80):
        w = list(base[i % 6])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(150)] = r.choice(words)
        texts.append(" ".join(w))
    got = {x.doc_id: x for x in simhash.simhash_groups(frame(spark, texts)).collect()}
    fps = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: x.fp & (2**64 - 1) for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == brute_groups(fps)
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    both = simhash.simhash_groups(frame(spark, ["x y", "x y", "x y"], [4, None, 4])).collect()
    assert [x.component_id for x in both] == [None] * 3


def near_prints(r):
    fps = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (300, 3)).astype(np.uint64), axis=1) for c in r.integers(0, 2**64, 5, dtype=np.uint64)])
    return np.unique(np.concatenate([fps, r.integers(0, 2**64, 500, dtype=np.uint64)]))


def test_large_buckets_are_dealt_anew_without_losing_links(spark):
    fps = near_prints(np.random.default_rng(5))
    whole = np.arange(len(fps))
    simhash.link_all(fps, 4, whole, np.arange(len(fps)))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for split in (40, 1 << 20):
        found = {x.node: x.component for x in components(simhash.links(nodes, 4, len(fps), split), len(fps)).collect()}
        own = np.array([found.get(int(x), int(x)) for x in fps.view(np.int64)])
        same = lambda a: a[:, None] == a[None, :]
        assert (same(own) == same(whole)).all()


def test_a_large_bucket_leaves_as_rows_however_the_batches_cut_it():
    import pyarrow as pa

    fps = np.sort(near_prints(np.random.default_rng(6)).view(np.int64))
    t = np.repeat([0, 1, 2], [700, 100, len(fps) - 800]).astype(np.int32)
    whole = pa.record_batch({"t": t, "key": np.zeros(len(fps), np.int64), "fp": fps})
    for step in (7, 99, 5000):
        out = [b for b in simhash.link((whole.slice(lo, step) for lo in range(0, len(fps), step)), 4, 300)]
        rows = [(a, u) for b in out for a, u in zip(b["t"].to_pylist(), b["u"].to_pylist(), strict=True) if a >= 0]
        assert sorted(rows) == sorted((a, u) for a, u in zip(t.tolist(), fps.tolist(), strict=True) if a != 1)


def test_few_free_bits_are_left_after_all_turns():
    free = [np.array([(2**64 - 1) ^ m for m in simhash.masks(4, turn)], np.uint64) for turn in range(simhash.TURNS)]
    left = free[0]
    for more in free[1:]:
        left = (left[:, None] & more[None, :]).ravel()
    assert np.bitwise_count(left).max() <= 16 and np.bitwise_count(left).mean() < 4


def test_masks_cover():
    r = random.Random(1)
    for turn in range(4):
        m = simhash.masks(4, turn)
        for _ in range(2000):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(diff & x == 0 for x in m)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99)], "u long, v long")
    got = {x.node: x.component for x in components(edges, 50).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_keep_first_keeps_one_row_of_each_group(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(r.choice(words) for _ in range(200))
    other = " ".join(r.choice(words) for _ in range(200))
    docs = frame(spark, [base, base, base, other, other, None, ""], [4, 4, 9, 2, 2, 7, 8])
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(x.doc_id for x in out.collect()) == [2, 4, 7]


def test_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3} " * 9, 7, 8, 9, 10) for i in range(9)], "doc_id long, text string, _k long, _h long, _n long, `x.k` long")
    out = simhash.keep_first(docs)
    assert out.schema == docs.schema
    assert sorted(tuple(x) for x in out.collect()) == [(i, f"text {i} " * 9, 7, 8, 9, 10) for i in range(3)]


def test_a_shared_or_missing_doc_id_links_nothing(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d, e = (" ".join(r.choice(words) for _ in range(200)) for _ in range(5))
    # two unrelated texts without doc_id, one of them repeated and with a copy under 3; two unrelated texts under 5
    docs = frame(spark, [a, b, b, b, c, d, e], [None, None, None, 3, 5, 5, 6])
    assert sorted((x.doc_id or -1, x.text) for x in simhash.keep_first(docs).collect()) == sorted([(-1, a), (-1, b), (5, c), (5, d), (6, e)])
    rows = simhash.simhash_groups(docs).collect()
    groups = {}
    for x in rows:
        groups.setdefault(x.component_fp, []).append((x.doc_id or -1, x.component_id or -1))
    assert sorted(sorted(g) for g in groups.values()) == [[(-1, -1)], [(-1, -1), (-1, -1), (3, -1)], [(5, 5)], [(5, 5)], [(6, 6)]]
