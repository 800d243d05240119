"""Operator 13, target-distribution importance resampling: hashed n-gram weights and a Gumbel top-k draw.

1. Each partition counts its features' buckets (crc32 of a run of 1 to ``runs``
   words, modulo ``buckets``) with np.bincount into one vector of ``buckets``
   longs; a tree reduction adds the vectors of the corpus, and another those of
   the target texts. A bucket's gain is the scaled log-ratio of its smoothed
   shares.
2. The gains (one vector of fixed length) go to every task; a second pass
   gathers each feature's gain and sums documents by np.bincount with weights.
   Gumbel noise from a hash of the doc_id turns the sum into a score.
3. The highest scores are drawn: rows are range-sorted by cuts from a bounded
   sample and numbered by their range's offset, so no task sees all of them.

Defined results: null text has no words; rows that repeat a doc_id count, are
weighed and drawn each by itself (ties of score and doc_id take the ranks of
their group in any order); a null doc_id hashes as the empty string and comes
first among ties; an empty target gives every bucket its smoothed share; texts
may have any length (they are read in stretches) and docs any other columns; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import arrow, pieces, scanned, settle, text_column
from wardline.operators.numbering import numbered

BUCKETS = 10_000
RUNS = 3
#: Characters of one text that are split into words at a time.
STRETCH = 1 << 20
#: Stretches whose buckets wait for one np.bincount.
MOST_HELD = 4096
#: Words of lower-cased texts, and what ends one in a text as it is: all below 0x80 but digits and letters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = {c: c + 32 for c in range(65, 91)}
SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def stretches(text: str, size: int = STRETCH):
    """The text cut behind words, at most about size characters at a time."""
    lo = 0
    while lo < len(text):
        gap = GAP.search(text, lo + size)
        hi = gap.start() if gap else len(text)
        yield text[lo:hi]
        lo = hi


def text_buckets(text: str, buckets: int = BUCKETS, runs: int = RUNS, size: int = STRETCH):
    """Per stretch of the text: its number of words, the buckets of the runs that end in it.

    A run's crc goes on from the crc of the run one word shorter; the last crcs
    of a stretch, per length of run, go on into the next.
    """
    before: list[list[int]] = [[] for _ in range(runs)]  # the crcs of the runs of each length that end with the latest word
    for stretch in stretches(text, size):
        words = [w.encode() for w in WORD.findall(stretch.translate(LOWER))]
        if not words:
            continue
        spaced = [b" " + w for w in words]
        found, own = [], list(map(crc32, words))
        for n in range(runs):
            if n:
                # a run that ends at a word goes on from the shorter run that ends one word earlier, maybe in the stretch before
                shorter = [*before[n - 1], *found[n - 1]]
                own = list(map(crc32, spaced[len(words) + 1 - len(shorter) :], shorter))
            found.append(own)
        for n in range(runs):
            before[n] = found[n][-1:]
        yield len(words), np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found))) % np.uint32(buckets)


def counted(batches, buckets: int, runs: int):
    """One vector for the partition: how many features each bucket has."""
    total = np.zeros(buckets, np.int64)
    for batch in pieces(batches):
        for text in text_column(batch["text"]):
            for _, own in text_buckets(text.as_py(), buckets, runs):
                total += np.bincount(own, minlength=buckets)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def corpus_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """Features of each bucket over all texts: a vector per partition, added up by a tree."""
    vectors = scanned(texts).select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: counted(it, buckets, runs), "counts binary")
    parts = vectors.rdd.map(lambda row: np.frombuffer(row["counts"], np.int64))
    return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's share of the target against its share of the corpus, one feature added to each; floored."""
    n = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def summed(row: list[int], found: list[np.ndarray], weights: np.ndarray, n: int) -> np.ndarray:
    """Of each of n documents, the sum of its features' weights; empties the lists."""
    at = np.repeat(np.array(row, np.int64), list(map(len, found)))
    out = np.bincount(at, weights[np.concatenate(found)], n) if found else np.zeros(n)
    row.clear(), found.clear()
    return out


def weighed(batches, gain: np.ndarray, runs: int):
    weights = gain.astype(np.float64)
    for batch in pieces(batches):
        n = batch.num_rows
        words, features, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        row, found = [], []
        for i, text in enumerate(text_column(batch["text"])):
            for count, own in text_buckets(text.as_py(), len(gain), runs):
                words[i] += count
                features[i] += len(own)
                row.append(i)
                found.append(own)
                if len(found) > MOST_HELD or len(own) > STRETCH:
                    sums += summed(row, found, weights, n)
        yield arrow(SCORED, batch["doc_id"], words, features, (sums + summed(row, found, weights, n)).astype(np.int64))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a hashed u in (0, 1)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: percent of the documents of at least least_words words drawn towards target; rank is null where not drawn."""
    gain = gains(corpus_counts(docs, buckets, runs), corpus_counts(target, buckets, runs))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    texts = scanned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(lambda it: weighed(it, sent.value, runs), "doc_id long, n_words long, n_features long, weight long")
    rows = settle(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
