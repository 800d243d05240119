"""Operator 4, language ID: nearest of several clustered centroids per language.

A text's hashed letter bigrams and trigrams (A-Z lower-cased, other ASCII as
word breaks) are weighted by log counts and inverse document frequency and
normalised. Each language's training vectors are clustered (spherical k-means,
farthest-point start) to ``clusters`` centroids; a text takes the language of
the centroid of largest cosine. It is *rejected* where that cosine is below
the language's floor for texts of as many distinct grams. Floors come from
random stretches of every length of the training texts, held against centroids
of the other half of the texts: they lie between the stretches' lowest cosines
(0.5 % quantile) and what stretches reach with all centroids but those of their
own language, at a third to two thirds of the former, so that short clean texts
stay.

Training reads a bounded sample of distinct labelled texts, chosen by a hash of
doc_id and text: about ``per_language`` of each language, MOST_ROWS in all, none
over LONGEST_LEARNED bytes (so a doc_id or text on many rows is one row of it);
the frequencies belong to the classifier and come from that sample. Texts are
used whole, in training as in prediction, whatever their length.

Defined results: null text or text without a letter is ``und`` with score 0
and rejected; without training rows everything is ``und``; a null doc_id is
not held out and never learned from; repeated rows each get the same result;
of equally near languages (ties) the first by name is taken; an empty table
gives an empty result; other columns of docs are not read by identify() and
kept by keep_identified().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import LOWER, arrow, blocks, keyed, raw, scanned, text_column

CODES = 1 << 13
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("rejected", pa.bool_())])
#: Characters of the stretches that floors are learned from, and how many values size_of() has, rounded down.
STRETCHES = (3, 6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200)
SIZES = CODES.bit_length()
#: Bounds of the training sample: rows in all, and bytes of a text.
MOST_ROWS, LONGEST_LEARNED = 8000, 1 << 17
LETTERS = LOWER.copy()
LETTERS[:65] = LETTERS[91:97] = LETTERS[123:128] = 32


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """documents x CODES gram counts."""
    n = len(off) - 1
    b = LETTERS[buf].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros(n * CODES)
    for size, add in ((2, 977), (3, 5)):
        if len(b) < size:
            continue
        m = len(b) - size + 1
        code = b[:m] * 31337 + add
        for i in range(1, size):
            code = code * 263 + b[i : i + m]
        code = (code ^ (code >> 13)) & (CODES - 1)
        same = row[:m] == row[size - 1 :]
        out += np.bincount((row[:m] * CODES + code)[same], minlength=n * CODES)
    return out.reshape(n, CODES)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(x) * idf).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def vectors(texts: pa.Array, idf: np.ndarray):
    buf, off = raw(texts)
    for lo, hi in blocks(off, 1 << 18):
        for a in range(lo, hi, 256):
            z = min(a + 256, hi)
            yield a, z, weigh(counts(buf[off[a] : off[z]], off[a : z + 1] - off[a]), idf)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """At most k unit centroids of the unit rows x."""
    mean = x.mean(0)
    pick = [int((x @ mean).argmax())]
    while len(pick) < min(k, len(x)):
        pick.append(int((x @ x[pick].T).max(1).argmin()))
    c = x[pick]
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def floors(texts: list[list[str]], x: list[np.ndarray], idf: np.ndarray, clusters: int, each: int = 150) -> np.ndarray:
    """languages x SIZES: the floor at size_of() b + 0.5, from each language's texts and their vectors x."""
    rng = np.random.default_rng(23)
    half = [[own[p::2] if len(own) > 1 else own for p in (0, 1)] for own in x]
    size, best, other, lang = [], [], [], []
    for p in (0, 1):
        c = [cluster(h[1 - p], clusters) for h in half]
        owner, c = np.repeat(np.arange(len(c)), list(map(len, c))), np.concatenate(c)
        for i, own in enumerate(texts):
            own = own[p::2] if len(own) > 1 else own
            cut = []
            for n in STRETCHES:
                for j in rng.integers(len(own), size=each):
                    at = rng.integers(max(1, len(own[j]) - n + 1))
                    cut.append(own[j][at : at + n])
            for v in [half[i][p], *(v for *_, v in vectors(pa.array(cut, pa.large_string()), idf))]:
                to = v @ c.T
                size.append(size_of(v))
                best.append(to.max(1))
                other.append(to[:, owner != i].max(1, initial=0))
                lang.append(np.full(len(v), i))
    size, best, other, lang = (np.concatenate(a) for a in (size, best, other, lang))
    at = size.astype(int)
    found = np.full((2, len(x), SIZES), np.nan)
    for i in range(len(x)):
        for b in range(SIZES):
            if (here := (lang == i) & (at == b)).sum() >= 40:
                found[:, i, b] = np.quantile(best[here], 0.005), np.quantile(other[here], 0.95)
    low, unseen = found
    rest = np.flatnonzero(~np.isnan(low).all(0))
    unseen[:, rest] = np.nanmedian(unseen[:, rest], 0)  # a label given wrongly here and there puts a language among the others
    floor = (low + 2 * np.minimum(unseen, low / 2)) / 3
    for row in floor:
        have = np.flatnonzero(~np.isnan(row))
        row[:] = np.interp(np.arange(SIZES), have, row[have]) if len(have) else 0
    return floor


def size_of(v: np.ndarray) -> np.ndarray:
    """Of vectors, the binary logarithm of 1 + their distinct grams."""
    return np.log2(1 + (v > 0).sum(1))


def sample(rows: DataFrame, label: str, bound: int, *keys: str) -> DataFrame:
    """About bound rows of each label at most, by a hash of the keys; a label's rows are counted first."""
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    bound = max(1, min(bound, MOST_ROWS // max(1, len(n))))
    u = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30))
    keep = F.lit(False)
    for value, many in n.items():
        keep = F.when(F.col(label) == F.lit(value), u < int((1 << 30) * min(1.0, bound / many))).otherwise(keep)
    return rows.where(keep)


def train(docs: DataFrame, per_language: int, clusters: int) -> dict:
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(3) != 1) & (F.octet_length("text") <= LONGEST_LEARNED))
    got = sample(rows, "lang", per_language, "doc_id", "text").dropDuplicates(["lang", "text"]).select("doc_id", "text", "lang").orderBy("doc_id", "text", "lang").toArrow()
    langs = got["lang"].to_pylist()
    names = sorted(set(langs))
    if not names:
        return {"names": []}
    texts = got["text"].combine_chunks()
    df = np.zeros(CODES)
    buf, off = raw(texts)
    for lo, hi in blocks(off, 1 << 18):
        df += (counts(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) > 0).sum(0)
    idf = np.log((1 + len(langs)) / (1 + df)) + 1
    x = np.concatenate([v for *_, v in vectors(texts, idf)])
    rows = [[j for j, a in enumerate(langs) if a == name] for name in names]
    centroids = [cluster(x[own], clusters) for own in rows]
    owner = np.repeat(np.arange(len(names)), list(map(len, centroids)))
    floor = floors([[texts[j].as_py() for j in own] for own in rows], [x[own] for own in rows], idf, clusters)
    return {"names": names, "idf": idf, "centroids": np.concatenate(centroids), "owner": owner, "floor": floor}


def judge(batches, model: dict):
    for batch in batches:
        texts, n = text_column(batch["text"]), batch.num_rows
        names, pred, score, cosine, floor = model["names"], np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n)
        if names:
            for a, z, x in vectors(texts, model["idf"]):
                to = x @ model["centroids"].T
                best = np.stack([to[:, model["owner"] == i].max(1) for i in range(len(names))], 1)
                pred[a:z], cosine[a:z] = best.argmax(1), np.clip(best.max(1), 0, 1)
                e = np.exp((best - best.max(1, keepdims=True)) / 0.05)
                score[a:z] = 1 / e.sum(1)
                size = size_of(x)
                for i in np.unique(pred[a:z]):
                    floor[a:z] = np.where(pred[a:z] == i, np.interp(size, np.arange(SIZES) + 0.5, model["floor"][i]), floor[a:z])
        lettered = np.array([bool(names) and any(map(str.isalpha, t.as_py())) for t in texts], bool)
        rejected = ~lettered | (cosine < floor if names else True)
        label = [names[p] if ok else "und" for p, ok in zip(pred, lettered, strict=True)]
        yield arrow(OUT, batch["doc_id"], label, np.where(lettered, score, 0.0), np.where(lettered, cosine, 0.0), rejected, *())


def identify(docs: DataFrame, per_language: int = 400, clusters: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine, rejected."""
    model = train(docs, per_language, clusters)
    out = keyed(docs).select("doc_id", "text").mapInArrow(lambda it: judge(it, model), "doc_id long, lang_pred string, score double, cosine double, rejected boolean")
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def keep_identified(docs: DataFrame, per_language: int = 400, clusters: int = 4) -> DataFrame:
    """The rows of docs that are not rejected, unchanged."""
    model = train(docs, per_language, clusters)
    schema = docs.schema

    def kept(batches):
        for batch in batches:
            for verdict in judge([batch], model):
                yield batch.filter(pa.compute.invert(verdict["rejected"]))

    return scanned(docs).mapInArrow(kept, schema)
