"""Operator 13 against a plain count of features."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import frame, noisy
from wardline.llm.resampling import corpus_counts, gains, resample, stretches, text_buckets


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(texts, ids, target):
    import hashlib

    s, t = (Counter(bucket(f) for text in x for f in features(text)) for x in (texts, target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in zip(ids, texts, strict=True):
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {}
    for n, r in enumerate(able[: 5 * len(able) // 100], 1):
        drawn.setdefault(r, []).append(n)
    return sorted((*(-1 if x is None else x for x in r), drawn[r].pop() if drawn.get(r) else 0) for r in rows)


def collected(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"] or 0) for r in rows.collect())


ODD = ["A-b_C", "Ünï  çode ÀB x9", "a" * 5000, "日本 語x", "~!@", "one two\x00three"]


def test_equals_a_plain_count(spark):
    texts, ids = noisy(2, 400) + ODD, [*range(400), *range(900, 906)]
    texts[40:45], ids[40:45] = [texts[40]] * 5, [40] * 5  # one row five times
    ids[50] = None
    target = noisy(8, 20)
    got = resample(frame(spark, texts, ids).repartition(6), frame(spark, target))
    assert collected(got) == brute(texts, ids, target)


@pytest.mark.parametrize("texts", [[], [None, "", "--"], ["w " * 30]])
def test_few_rows_and_an_empty_target(spark, texts):
    assert collected(resample(frame(spark, texts), frame(spark, []))) == brute(texts, range(len(texts)), [])


def test_a_third_of_the_rows_is_one_row(spark):
    texts, ids = ["same words " * 20] * 2000 + noisy(3, 300), [7] * 2000 + [*range(1000, 1300)]
    rows = resample(frame(spark, texts, ids).repartition(8), frame(spark, ["same words"])).collect()
    able = sum(len(words(t)) >= 20 for t in texts)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 5 * able // 100 + 1)) and len(rows) == 2300


def test_stretches_change_nothing():
    for text in [*(t or "" for t in noisy(5)), *ODD, "x y z"]:
        for size in (1, 3, 7, 50):
            assert "".join(stretches(text, size)) == text
            cut = [b for n, own in text_buckets(text, size=size) for b in own.tolist()]
            assert Counter(cut) == Counter(map(bucket, features(text)))


def test_a_very_long_text(spark):
    text = "lorem ipsum dolor " * 200_000
    (row,) = resample(frame(spark, [text]), frame(spark, ["dolor lorem"])).collect()
    assert row.n_features == 3 * 600_000 - 3 and row.n_words == 600_000


def test_vectors_of_the_partitions_add_up(spark):
    texts = noisy(6, 100)
    want = np.zeros(10000, np.int64)
    for t in texts:
        for f in features(t):
            want[bucket(f)] += 1
    got = corpus_counts(frame(spark, texts).repartition(9))
    assert (got == want).all() and (gains(got, got) == 0).all()
