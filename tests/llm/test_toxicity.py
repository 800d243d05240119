import random
import zlib

import numpy as np

from tests.llm.helpers import frame
from wardline.llm import toxicity as tx


def world(n=500, seed=4):
    r = random.Random(seed)
    words = [a + b for a in ("the", "an", "of", "er", "ing", "ti") for b in ("on", "ed", "ly", "re", "sh", "ble")]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(3, 150))]
        bad = i % 4 == 0
        for _ in range(1 + len(w) // 30 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "lowei" + r.choice(words)]))
        texts.append(" ".join(w))
        labels.append((i, int(bad), "x"))
    return texts, labels


def test_held_out_accuracy_and_odd_rows(spark):
    texts, labels = world()
    texts += [None, "", " \n", "word " * 20000 + "idiot"]
    marks = spark.createDataFrame([*labels, (None, 1, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in tx.score_toxicity(frame(spark, texts), marks).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and i < 500]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[500].score == got[501].score == got[502].score < 0.3


def test_no_labels_and_empty_tables(spark):
    texts, _ = world(8)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.score_toxicity(frame(spark, texts), none).collect()} == {0.0}
    assert tx.score_toxicity(frame(spark, []), none).collect() == []


def test_gradients_are_right():
    p = {k: v.astype(np.float64) for k, v in tx.initial(np.random.default_rng(0)).items()}
    texts = b"some words of a text here another text of fewer words"
    t = tx.Text(np.frombuffer(texts, np.uint8), np.array([0, 26, len(texts)]))
    pick, y = np.array([0, 1]), np.array([1.0, 0.0])
    loss = lambda: float(np.mean([np.log1p(np.exp(-z)) if a else np.log1p(np.exp(z)) for z, a in zip(tx.forward(p, t, pick)[0], y, strict=True)]))
    g = tx.gradients(p, t, pick, y)
    for name, x in p.items():
        flat, where = x.reshape(-1), np.abs(g[name]).argmax()
        old = flat[where]
        flat[where] = old + 1e-2
        up = loss()
        flat[where] = old - 1e-2
        down = loss()
        flat[where] = old
        assert abs((up - down) / 2e-2 - g[name].reshape(-1)[where]) < 1e-3 + 0.02 * abs(g[name]).max(), name


def plain(p, text):
    """Largest logit and windows of a text, window by window and word by word, without the module's batching."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    words = re.findall(rb"[^ \t-\r]+", low)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(w):
        b = [1, *w, 2]
        codes = [((a * 263 + m) * 269 + z) for a, m, z in zip(b, b[1:], b[2:])]
        grams = sum(p["grams"][(c ^ (c >> 9)) & (tx.GRAMS - 1)].astype(float) for c in codes) / np.sqrt(len(w))
        bucket = int(tx.Text(np.frombuffer(w, np.uint8), np.array([0, len(w)])).bucket[0])
        return np.concatenate([p["words"][bucket], grams])

    def states(x, d):
        h, out = np.zeros(tx.HIDDEN), [None] * len(x)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            gx, gh = x[t] @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            r, z = np.split(sig(gx[: 2 * tx.HIDDEN] + gh[: 2 * tx.HIDDEN]), 2)
            h = z * h + (1 - z) * np.tanh(gx[2 * tx.HIDDEN :] + r * gh[2 * tx.HIDDEN :])
            out[t] = h
        return np.array(out)

    n = len(words)
    begins = [0] if n <= tx.SPAN else range(0, n - tx.SPAN + tx.STRIDE, tx.STRIDE)
    best = []
    for lo in begins:
        x = [vector(w) for w in words[lo : lo + tx.SPAN]]
        h = np.concatenate([states(x, "f"), states(x, "b")], 1)
        a = np.exp(h @ p["query"] - (h @ p["query"]).max())
        best.append((a / a.sum()) @ h @ p["out"] + p["bias"][0])
    return max(best), len(begins)


def test_scores_against_a_plain_network():
    import pyarrow as pa

    texts, labels = world(80)
    model = tx.fit(pa.array(texts), np.array([y for _, y, _ in labels]), 0.25)
    r = random.Random(5)
    some = [*texts[:12], "Ein Wort", " ".join(r.choice(texts).split()[0] for _ in range(33)), "é ß \t 漢字 x" * 9]
    got = np.concatenate([b["score"].to_numpy() for b in tx.scores([pa.record_batch({"doc_id": list(range(len(some))), "text": some})], model)])
    for s, text in zip(got, some, strict=True):
        top, windows = plain(model, text)
        want = 1 / (1 + np.exp(-np.array([top, np.log(windows), 1]) @ model["logistic"]))
        assert abs(s - want) < 1e-4, text


def test_a_long_text_scores_as_one(monkeypatch):
    """Stretch by stretch as all at once, also with a word of many bytes and at every number of words around the borders."""
    texts, labels = world(80)
    import pyarrow as pa

    model = tx.fit(pa.array(texts), np.array([y for _, y, _ in labels]), 0.25)
    words = " ".join(texts).split()
    one = lambda n, big: np.frombuffer((" ".join(words[:n]) + " " + "z" * big).encode(), np.uint8)
    cases = [one(n, big) for n in (1, 24, 31, 32, 33, 95, 96, 97, 103, 104, 105, 127, 128, 129, 500, 2000) for big in (0, 3000)]
    whole = [tx.text_features(model, b, np.array([0, len(b)])) for b in cases]
    monkeypatch.setattr(tx, "STRETCH", 4)
    monkeypatch.setattr(tx, "TOGETHER", 700)
    for b, want in zip(cases, whole, strict=True):
        assert np.abs(tx.long_features(model, b) - want).max() < 1e-4


def test_one_doc_id_on_many_rows_is_one_training_text(spark):
    texts, labels = world(200)
    docs = frame(spark, [*texts, *["the same text again"] * 5000], [*range(200), *[3] * 5000])
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"), 50)
    assert "words" in model
