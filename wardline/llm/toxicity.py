"""Operator 10, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a hashed word vector beside the scaled sum of its hashed
character trigrams (A-Z lower-cased). Both directions run over windows of SPAN
words that overlap; attention pools a window's states to a logit. A text's
score is a logistic of its largest window logit and its number of windows,
fitted with the label frequencies of all training rows.

Training reads a bounded sample, about ``per_label`` training rows of each
label at most, chosen by a hash of doc_id; a doc_id on many rows is one text
(the smallest), and texts over LONGEST_LEARNED bytes are not learned from. It
first learns from all windows of the sample and then, round by round, from the
windows that score highest in each document (one of label 1, three of label 0:
labels are per document). Each step leaves out the vectors of a share DROP of
the words, so that a small sample is not learned by heart. Scoring covers every
window of every whole text, a long text some thousand windows at a time; words
are looked up once per block.

Defined results: null, empty or wordless text scores as the median label 0 text of the sample; without
training rows of both labels every score is the mean label (0 if there is
none); a null doc_id is not held out and never learned from; of several labels
of a doc_id (ties) 1 wins; repeated rows each get the same score; an empty
table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import BYTE_CODES, IS_SPACE, LOWER, Ranges, arrow, blocks, keyed, raw, text_column, word_bounds
from wardline.llm.language_id import LONGEST_LEARNED, remainder, sample

WORDS, GRAMS, WIDTH, HIDDEN = 1 << 14, 1 << 12, 8, 8
SPAN, STRIDE = 32, 24
#: Share of the distinct words whose own vector a training step leaves out, so that spelling is learned too.
DROP = 0.7
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

#: Bytes of texts (or trigrams of words) that are taken together.
TOGETHER = 1 << 19

# ------------------------------------------------------------- input


class Text:
    """Windows of a block of documents over its distinct words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        low = LOWER[buf]
        starts, ends, doc = word_bounds(buf, off)
        hashes = Ranges(BYTE_CODES[0][low], 0).hash(starts, ends) if len(starts) else np.empty(0, np.uint64)
        kinds, first, own = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (kinds % np.uint64(WORDS)).astype(np.int64)
        s, e = starts[first], ends[first]
        n = e - s
        lead = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(s - lead, n)
        before = np.where(at == np.repeat(s, n), 1, low[at - 1])
        after = np.where(at == np.repeat(e, n) - 1, 2, low[np.minimum(at + 1, max(len(low) - 1, 0))]) if len(at) else at
        code = (before.astype(np.int64) * 263 + (low[at] if len(at) else at)) * 269 + after
        self.grams, self.lead, self.n = (code ^ (code >> 9)) & (GRAMS - 1), lead, n
        # windows: words of each, padded with -1
        count = np.bincount(doc, minlength=len(off) - 1)
        many = np.where(count > SPAN, -(-(count - SPAN) // STRIDE) + 1, 1)
        self.doc = np.repeat(np.arange(len(count)), many)
        base = np.cumsum(count) - count
        begin = (np.arange(len(self.doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        place = begin + np.arange(SPAN)[:, None]
        inside = place < count[self.doc]
        place = np.where(inside, place + base[self.doc], 0)
        self.word = np.where(inside, own[place] if len(own) else 0, -1)
        self.windows = many


def inputs(p: dict, t: Text, kinds: np.ndarray) -> np.ndarray:
    """Input vectors of the distinct words ``kinds``: word vector, trigram sum over the root of its length."""
    n = t.n[kinds]
    lead = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(t.lead[kinds] - lead, n)
    chars = np.zeros((len(kinds), WIDTH), np.float32)
    for lo in range(0, len(at), TOGETHER):  # a word may be longer than that
        first = np.unique(np.maximum(lead[np.searchsorted(lead, lo, "right") - 1 : np.searchsorted(lead, lo + TOGETHER)] - lo, 0))
        own = np.searchsorted(lead, lo, "right") - 1
        chars[own : own + len(first)] += np.add.reduceat(p["grams"][t.grams[at[lo : lo + TOGETHER]]], first)
    chars /= np.sqrt(n)[:, None]
    return np.concatenate([p["words"][t.bucket[kinds]], chars], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# ------------------------------------------------------------- network


def initial(rng: np.random.Generator) -> dict:
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    p = {"words": draw(WORDS, WIDTH, s=0.1), "grams": draw(GRAMS, WIDTH, s=0.3), "query": draw(2 * HIDDEN, s=0.3), "out": draw(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": draw(2 * WIDTH, 3 * HIDDEN, s=0.3), f"u{d}": draw(HIDDEN, 3 * HIDDEN, s=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def run(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """States (time, batch, hidden) of one direction. gates: input gates of each distinct word; the last row is padding."""
    steps, batch = index.shape
    h, out, saved = np.zeros((batch, HIDDEN), np.float32), np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        gx, gh, m = gates[index[t]], h @ u, mask[t]
        rz = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        keep_h = 1 - m * (1 - z)
        if keep:
            saved.append((t, h, r, z, n, gh[:, 2 * HIDDEN :]))
        h = keep_h * h + (1 - keep_h) * n
        out[t] = h
    return out, saved


def run_back(grad: np.ndarray, saved: list, mask: np.ndarray, u: np.ndarray):
    """Gradients by input gate (time, batch, 3 hidden) and by u."""
    dgx, du = np.zeros((*grad.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u)
    dh = np.zeros(grad.shape[1:], np.float32)
    for t, h, r, z, n, ghn in reversed(saved):
        dh = dh + grad[t]
        m = mask[t]
        dn = dh * m * (1 - z) * (1 - n * n)
        dz = dh * m * (h - n) * z * (1 - z)
        dr = dn * ghn * r * (1 - r)
        dgx[t] = np.concatenate([dr, dz, dn], 1)
        dgh = np.concatenate([dr, dz, dn * r], 1)
        du += h.T @ dgh
        dh = dh * (1 - m * (1 - z)) + dgh @ u.T
    return dgx, du


def forward(p: dict, t: Text, pick: np.ndarray, keep: bool = False, seen: np.ndarray | None = None):
    """Logits of the windows ``pick``. seen: a factor for the word vector of each of t's distinct words (training leaves some out)."""
    word = t.word[:, pick]
    kinds, index = np.unique(word, return_inverse=True)
    index = index.reshape(word.shape)
    pad = int(len(kinds) and kinds[0] == -1)
    x = inputs(p, t, kinds[pad:])
    if seen is not None:
        x[:, :WIDTH] *= seen[kinds[pad:], None]
    if pad:
        x = np.concatenate([np.zeros((1, 2 * WIDTH), np.float32), x])
    mask = (word >= 0).astype(np.float32)[:, :, None]
    states, saved = [], {}
    for d in "fb":
        h, saved[d] = run(x @ p[f"w{d}"] + p[f"c{d}"], index, mask, p[f"u{d}"], d == "b", keep)
        states.append(h)
    h = np.concatenate(states, 2)
    e = np.where(mask[:, :, 0] > 0, h @ p["query"], -1e9)
    a = np.exp(e - e.max(0)) * mask[:, :, 0]
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = (a[:, :, None] * h).sum(0)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (kinds, index, pad, x, mask, saved, h, a, pooled) if keep else None


def gradients(p: dict, t: Text, pick: np.ndarray, target: np.ndarray, seen: np.ndarray | None = None) -> dict:
    logit, (kinds, index, pad, x, mask, saved, h, a, pooled) = forward(p, t, pick, True, seen)
    d = ((sigmoid(logit) - target) / len(target)).astype(np.float32)
    g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    dpool = d[:, None] * p["out"]
    da = (h * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    g["query"] = np.einsum("tbh,tb->h", h, de)
    dh = a[:, :, None] * dpool + de[:, :, None] * p["query"]
    dx = np.zeros_like(x)
    for i, way in enumerate("fb"):
        dgx, g[f"u{way}"] = run_back(dh[:, :, i * HIDDEN : (i + 1) * HIDDEN], saved[way], mask, p[f"u{way}"])
        by = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(by, index.ravel(), dgx.reshape(-1, 3 * HIDDEN))
        g[f"w{way}"], g[f"c{way}"] = x.T @ by, by.sum(0)
        dx += by @ p[f"w{way}"].T
    kinds, dx = kinds[pad:], dx[pad:]
    g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
    np.add.at(g["words"], t.bucket[kinds], dx[:, :WIDTH] if seen is None else dx[:, :WIDTH] * seen[kinds, None])
    n = t.n[kinds]
    lead = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(t.lead[kinds] - lead, n)
    np.add.at(g["grams"], t.grams[at], np.repeat(dx[:, WIDTH:] / np.sqrt(n)[:, None], n, 0))
    return g


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.n += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-6)


def window_logits(p: dict, t: Text) -> np.ndarray:
    return np.concatenate([forward(p, t, np.arange(lo, min(lo + 2048, len(t.doc))))[0] for lo in range(0, len(t.doc), 2048)])


def features(logits: np.ndarray, t: Text) -> np.ndarray:
    lead = np.cumsum(t.windows) - t.windows
    return np.stack([np.maximum.reduceat(logits, lead), np.log(t.windows), np.ones(len(lead))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b += np.linalg.solve(hess, x.T @ (weight * (y - q)) - 1e-2 * b)
    return b


def fit(texts: pa.Array, y: np.ndarray, share: float) -> dict:
    """Network and text-level logistic from labelled texts; share: the fraction of label 1 among all training rows."""
    if len(set(y.tolist())) < 2:
        return {"mean": float(y.mean()) if len(y) else 0.0}
    rng, rounds = np.random.default_rng(11), int(np.clip(12_000 / len(y), 5, 20))  # a smaller sample is gone through more often
    t = Text(*raw(texts))
    p = initial(rng)
    adam = Adam(p, 0.02)
    label = y[t.doc]

    def epoch(pick: np.ndarray) -> None:
        pick = rng.permutation(pick)
        for lo in range(0, len(pick), 256):
            part = pick[lo : lo + 256]
            seen = (rng.random(len(t.bucket)) >= DROP).astype(np.float32) / (1 - DROP)
            adam.step(gradients(p, t, part, label[part].astype(np.float32), seen))

    epoch(np.arange(len(t.doc)))
    for i in range(rounds):
        logits = window_logits(p, t)
        order = np.lexsort((-logits, t.doc))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(t.windows) - t.windows, t.windows)
        top = order[(rank == 0) | ((rank < 3) & (label[order] == 0))]
        adam.rate = 0.02 / (1 + i)
        for _ in range(2):
            epoch(top)
    x = features(window_logits(p, t), t)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return p | {"logistic": logistic(x, y, weight), "empty": float(np.median(x[y == 0, 0]))}


def train(docs: DataFrame, labels: DataFrame, per_label: int) -> dict:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(remainder(4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    # the sample is bounded whatever the tables hold, so the texts stay where they are
    chosen = F.broadcast(sample(marks, "toxic", per_label, "doc_id").limit(4 * per_label))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.octet_length("text") <= LONGEST_LEARNED)).join(chosen, "doc_id")
    got = known.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    y = np.array(got["toxic"].to_pylist(), np.int64)
    texts = got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string())
    return fit(texts, y, n.get(1, 0) / max(1, sum(n.values())))


#: Windows of a long text that are scored together.
STRETCH = 4096


def stretches(buf: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of a text that hold STRETCH of its windows each (the last one the rest), without the words of all of it at once."""
    step, cuts, n, before = STRETCH * STRIDE, {}, 0, False
    for lo in range(0, len(buf), TOGETHER):
        inside = ~IS_SPACE[buf[lo : lo + TOGETHER]]
        start = np.flatnonzero(inside & ~np.append(before, inside[:-1]))
        # a stretch begins with word i * step and ends before word (i + 1) * step + SPAN - STRIDE
        for at in (*range(-(-n // step) * step, n + len(start), step), *(i for i in range(SPAN - STRIDE + -(-(n - SPAN + STRIDE) // step) * step, n + len(start), step) if i >= n)):
            cuts[at] = lo + int(start[at - n])
        n, before = n + len(start), bool(inside[-1])
    windows = -(-(n - SPAN) // STRIDE) + 1 if n > SPAN else 1
    many = -(-windows // STRETCH)
    return [(cuts.get(i * step, 0), cuts.get((i + 1) * step + SPAN - STRIDE, len(buf)) if i + 1 < many else len(buf)) for i in range(many)]


def text_features(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of each text; a text without a word gets the model's ``empty`` logit."""
    t = Text(buf, off)
    x = features(window_logits(model, t), t)
    x[t.word[0, np.cumsum(t.windows) - t.windows] < 0, 0] = model["empty"]
    return x


def long_features(model: dict, buf: np.ndarray) -> np.ndarray:
    """Features of one long text, a stretch at a time: the largest logit, the sum of the windows."""
    parts = np.concatenate([text_features(model, buf[a:b], np.array([0, b - a])) for a, b in stretches(buf)])
    return np.array([[parts[:, 0].max(), np.log(np.exp(parts[:, 1]).sum().round()), 1.0]])


def scores(batches, model: dict):
    for batch in batches:
        buf, off = raw(text_column(batch["text"]))
        out = np.full(batch.num_rows, model.get("mean", 0.0))
        if "mean" not in model:
            for lo, hi in blocks(off, TOGETHER):
                own = buf[off[lo] : off[hi]]
                x = long_features(model, own) if len(own) > TOGETHER else text_features(model, own, off[lo : hi + 1] - off[lo])
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(x @ model["logistic"], -30, 30)))
        yield arrow(SCORES, batch["doc_id"], out)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 1200, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, per_label)
    out = keyed(docs).select("doc_id", "text").mapInArrow(lambda it: scores(it, model), "doc_id long, score double")
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
