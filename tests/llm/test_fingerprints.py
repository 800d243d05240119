"""Operator 11 against hashes of spans taken digit by digit."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import frame, noisy
from wardline.llm import fingerprints
from wardline.llm.common import NULL_KEY
from wardline.llm.fingerprints import BASES, EMPTY, NARROW, NARROW_TO, PRIME, SLOT_BITS, SLOTS, SPREAD, WIDE, WIDE_FROM, Prefixes, as_codes, edited, likeness

ODD = ["", "a", "ab", "abc", "abcd", "日本語 😀!!", "\x00\x00", "é" * 40, "\n", "word", "the same start and then one end", "the same start and then another end"]


def span_hash(text, base):
    return sum((ord(c) + 1) * pow(base, i, PRIME) for i, c in enumerate(text)) % PRIME


def brute_print(text):
    widths = [WIDE] * (len(text) >= WIDE_FROM) + [min(NARROW, len(text))] * (0 < len(text) < NARROW_TO)
    least = {}
    for w in widths:
        for i in range(len(text) - w + 1):
            f = span_hash(text[i : i + w], BASES[0]) * SPREAD % PRIME
            slot, x = f >> SLOT_BITS, f & ((1 << SLOT_BITS) - 1)
            least[slot] = min(x, least.get(slot, x))
    return "".join(f"{span_hash(text, b):08x}" for b in BASES) + "".join(f"{least[s] % EMPTY:02x}" if s in least else "ff" for s in range(SLOTS))


def common(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def brute(texts, ids):
    import xxhash

    def key(i, t):
        h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        return NULL_KEY if i is None else i, h - 2**64 if h >= 2**63 else h

    order = sorted({(key(i, t), t or "") for i, t in zip(ids, texts, strict=True)}, reverse=True)
    following = {k: order[(n + 1) % len(order)][1] for n, (k, _) in enumerate(order)}
    rows = []
    for i, t in zip(ids, texts, strict=True):
        nxt, t = following[key(i, t)], t or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        own, changed, other = map(brute_print, (t, e, nxt))
        rows.append((-1 if i is None else i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, other), common(t, e), common(t, nxt)))
    return sorted(rows)


def collected(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in rows.collect())


@pytest.mark.parametrize("n", [1, 5])
def test_equals_hashes_by_hand(spark, n):
    texts = [t and t[:150] for t in noisy(2, 60)] + ODD
    ids = [*range(10, 70), *range(100, 100 + len(ODD))]
    ids[20] = ids[21] = None  # two texts without a doc_id
    ids[30] = ids[31]  # one doc_id, two texts
    texts += [texts[5]] * 3
    ids += [ids[5]] * 3  # one row four times
    assert collected(fingerprints.fingerprints(frame(spark, texts, ids).repartition(n))) == brute(texts, ids)


@pytest.mark.parametrize("texts", [[], [None], ["only one text of some length"], ["x", "x"], ["", None, ""]])
def test_few_rows(spark, texts):
    assert collected(fingerprints.fingerprints(frame(spark, texts))) == brute(texts, list(range(len(texts))))


def test_a_third_of_the_rows_is_one_row(spark):
    texts, ids = ["the same row again " * 3] * 3000 + noisy(7, 200), [500] * 3000 + [*range(400, 600)]
    texts = [t and t[:80] for t in texts]
    rows = fingerprints.fingerprints(frame(spark, texts, ids).repartition(6))
    assert collected(rows) == brute(texts, ids)


def test_ranges_hold_about_equal_bytes(spark):
    """A third of the rows have no doc_id: they spread over ranges by their texts' hashes."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcdef ", k=60)) for _ in range(3000)]
    ids = [None if i % 3 == 0 else i for i in range(3000)]
    rows = fingerprints.fingerprints(frame(spark, texts, ids).repartition(6))
    sizes = rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == 3000 and max(sizes) < 2 * 3000 / 4


def test_spans_and_extensions_of_a_long_sequence(monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 1 << 20)
    r = np.random.default_rng(1)
    text = "".join(map(chr, r.integers(97, 99, 1000))) * 1200  # 1.2 million: beyond one table of powers
    at = Prefixes(as_codes(text))
    a, b = np.array([5, 1_199_000, 3]), np.array([1_000_005, 0, 4])
    assert at.equal(a, b, np.array([100_000, 1000, 500])).tolist() == [True, True, False]
    most = len(text) - np.maximum(a, b)
    assert at.extension(a, b, most).tolist() == [common(text[i:], text[j:]) for i, j in zip(a, b, strict=True)]
    start = np.array([0, 10, 1_100_000])
    want = [span_hash(text[i : i + 50], BASES[0]) << 31 | span_hash(text[i : i + 50], BASES[1]) for i in start]
    assert at.span(start, start + 50).tolist() == want


def test_a_very_long_text(spark):
    r = random.Random(6)
    text = "".join(r.choices("abcdefghijklmnop ", k=1_500_000))
    rows = {x.doc_id: x for x in fingerprints.fingerprints(frame(spark, [text, "short one"], [2, 1])).collect()}
    assert rows[2].n_chars == len(text) and rows[2].prefix_edited == 1_000_000 and rows[2].edited_sha256 == hashlib.sha256(edited(text, "short one").encode()).hexdigest()
    assert 0.4 < rows[2].near_edited < 0.9 and rows[2].near_next < 0.1
    assert [int(x, 16) for x in (rows[2].fingerprint[:8], rows[2].fingerprint[8:16])] == [span_hash(text, b) for b in BASES]


def test_likeness_tells_edited_texts_from_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in fingerprints.fingerprints(docs).collect() if r.prefix_next < r.n_chars // 4 and r.n_chars > 200]
    assert len(rows) > 100
    assert sum(r.near_edited > 0.25 for r in rows) > 0.95 * len(rows)
    assert sum(r.near_next < r.near_edited for r in rows) > 0.97 * len(rows)
