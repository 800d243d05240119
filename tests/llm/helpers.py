"""Small hostile document sets, shared by the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, region string"


def frame(spark, texts, ids=None, langs=None):
    """documents with extra columns whose names clash with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or {}).get(i), None, None if t is None else len(t), "x", None, "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def noisy(seed, n=60, vocabulary=40, longest=120):
    """Texts with shared passages, copies, odd white space, nulls and empty ones."""
    r = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"é{i}ß" for i in range(vocabulary)]
    shared = [[r.choice(words) for _ in range(r.randint(15, 50))] for _ in range(4)]
    out = []
    for _ in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, longest))]
        if r.random() < 0.6:
            p = r.randint(0, len(w))
            w[p:p] = r.choice(shared)
        out.append("".join(x + r.choice([" ", " ", "  ", "\n", "\t"]) for x in w))
    out[3], out[4], out[5] = None, "", " \n\t "
    out[7] = out[8] = out[9]
    return out
