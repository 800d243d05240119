"""Operator 11, document fingerprints: prefix polynomial hashes.

Code points, as digits of a number in a fixed base modulo 2^31 - 1, are summed
up to every place; two bases give two such prefix arrays. The hash of any span
is a difference of two entries, moved to place 0 by an inverse power, so any two
spans of any texts compare at once, and the longest common extension of two
places is found by binary search.

A text's fingerprint holds the two hashes of the whole text (16 hex digits) and
a sketch of its spans of WIDE code points (short texts: of NARROW, or both):
the first of them in each of SLOTS ranges of hash values (two hex digits each,
``ff`` where none falls). The likeness of two fingerprints is 1 where they are
equal, else the share of the slots used by either in which they agree: an
estimate of the share of common spans, with a standard error of about 0.06 and
1 in 255 agreements by chance.

Documents are put in descending order by a range sort with byte-weighted cuts;
the first document of each range also goes, as a follower, to the range before,
so every document meets the next one in its own task.

Defined results: null text is empty; rows that repeat doc_id and text count
once in the order and get the same result; equal doc_ids with other texts are
ordered by a text hash (ties); a null doc_id comes last; an only document is its
own next one; two empty texts are alike; a text of n code points takes some 12n
bytes, whatever its length; docs may have any other columns; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import arrow, keyed, partitions, scanned, settle, text_column

PRIME = (1 << 31) - 1
#: The bases of the two prefix arrays, and what spreads the spans' hashes over the slots.
BASES = (1_103_515_245, 747_796_405)
SPREAD = 1_597_334_677
#: Places that one table of powers covers.
BLOCK = 1 << 20
#: Code points of one pass.
PASS = 1 << 19
WIDE, NARROW = 16, 3
#: Texts from WIDE_FROM code points on have wide spans, below NARROW_TO narrow ones.
WIDE_FROM, NARROW_TO = 48, 96
SLOTS, SLOT_BITS, EMPTY = 64, 25, 255
#: Sampled rows for each partition that set the ranges, and what a row costs besides its text.
SAMPLED, ROW_BYTES = 100, 64
PLACED = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("text", pa.large_string()), ("follows", pa.bool_()), ("part", pa.int32())])
PRINTS = pa.schema([
    ("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("prefix_edited", pa.int64()), ("prefix_next", pa.int64()),
])
SHAPE = "doc_id long, k long, h long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^62."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def powers(base: int) -> np.ndarray:
    """base^0 to base^(BLOCK - 1), doubled up."""
    out = np.ones(1, np.uint64)
    while len(out) < BLOCK:
        out = np.concatenate([out, folded(out * np.uint64(pow(base, len(out), PRIME)))])
    return out


class Tables:
    """Powers of the bases and of their inverses; made once in each worker."""

    made: Tables | None = None

    def __init__(self) -> None:
        self.up, self.down = [powers(b) for b in BASES], [powers(pow(b, -1, PRIME)) for b in BASES]
        self.spread = folded(self.down[0] * np.uint64(SPREAD))

    @classmethod
    def get(cls) -> Tables:
        cls.made = cls.made or cls()
        return cls.made


class Prefixes:
    """The prefix arrays of a sequence of code points."""

    def __init__(self, codes: np.ndarray) -> None:
        self.tables, self.size = Tables.get(), len(codes)
        self.sums = [np.zeros(len(codes) + 1, np.uint32) for _ in BASES]
        for which, base in enumerate(BASES):
            carry = np.uint64(0)
            for lo in range(0, len(codes), BLOCK):
                part = codes[lo : lo + BLOCK].astype(np.uint64) + np.uint64(1)
                terms = folded(part * self.tables.up[which][: len(part)])
                if lo:
                    terms = folded(terms * np.uint64(pow(base, lo, PRIME)))
                upto = folded(np.cumsum(terms) + carry)
                self.sums[which][lo + 1 : lo + 1 + len(part)] = upto
                carry = upto[-1]

    def _moved(self, which: int, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
        sums = self.sums[which]
        gap = sums[end].astype(np.uint64) + np.uint64(PRIME) - sums[start]
        out = folded(folded(gap) * down[start & (BLOCK - 1)])
        if self.size > BLOCK:
            far = pow(BASES[which], -BLOCK, PRIME)
            far = np.array([pow(far, i, PRIME) for i in range(self.size // BLOCK + 1)], np.uint64)
            out = folded(out * far[start >> 20])
        return out

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hash of each span [start, end)."""
        one, two = (self._moved(i, start, end, self.tables.down[i]) for i in range(2))
        return one << np.uint64(31) | two

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of a length at a and at b are equal."""
        return self.span(a, a + length) == self.span(b, b + length)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common span at a and b, at most most: found by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def spread(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """31-bit hash of each span, spread evenly: a feature of the sketch."""
        return self._moved(0, start, end, self.tables.spread)


@dataclass
class Prints:
    """Fingerprints of several texts, as arrays."""

    whole: np.ndarray
    slots: np.ndarray

    def shown(self) -> list[str]:
        return [f"{w >> 31:08x}{w & PRIME:08x}{s.tobytes().hex()}" for w, s in zip(self.whole.tolist(), self.slots, strict=True)]

    def __getitem__(self, at) -> Prints:
        return Prints(self.whole[at], self.slots[at])

    def likeness(self, other: Prints) -> np.ndarray:
        used = ((self.slots != EMPTY) | (other.slots != EMPTY)).sum(1)
        same = ((self.slots == other.slots) & (self.slots != EMPTY)).sum(1)
        equal = (self.whole == other.whole) & (self.slots == other.slots).all(1)
        return np.where(equal, 1.0, same / np.maximum(used, 1))


def likeness(one: str, two: str) -> float:
    """Likeness of two fingerprints as written."""
    if one == two:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(t[16:]), np.uint8) for t in (one, two))
    used = ((x != EMPTY) | (y != EMPTY)).sum()
    return float(((x == y) & (x != EMPTY)).sum() / max(used, 1))


def prints(at: Prefixes, off: np.ndarray) -> Prints:
    """Fingerprints of the texts that lie at [off[i], off[i + 1])."""
    n = np.diff(off)
    least = np.full(len(n) * SLOTS, 1 << SLOT_BITS, np.uint32)

    def sketch(row: np.ndarray, start: np.ndarray, width) -> None:
        feature = at.spread(start, start + width)
        np.minimum.at(least, row * SLOTS + (feature >> np.uint64(SLOT_BITS)).astype(np.int64), (feature & np.uint64((1 << SLOT_BITS) - 1)).astype(np.uint32))

    for lo, hi in blocks_of(n):
        for rows, width in ((np.flatnonzero(n[lo:hi] >= WIDE_FROM) + lo, np.full(hi - lo, WIDE)), (np.flatnonzero((n[lo:hi] < NARROW_TO) & (n[lo:hi] > 0)) + lo, np.minimum(n[lo:hi], NARROW))):
            count = n[rows] - width[rows - lo] + 1
            for first in range(0, int(count.max(initial=0)), PASS):  # one turn, but for a text of its own pass
                part = np.clip(count - first, 0, PASS)
                row = np.repeat(rows, part)
                start = np.arange(part.sum()) + np.repeat(off[rows] + first - (np.cumsum(part) - part), part)
                sketch(row, start, width[row - lo])
    slots = np.where(least == 1 << SLOT_BITS, EMPTY, least % EMPTY).astype(np.uint8).reshape(-1, SLOTS)
    return Prints(at.span(off[:-1], off[1:]), slots)


def blocks_of(n: np.ndarray):
    """Ranges of texts of about PASS code points in all."""
    upto, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PASS, "right")))
        yield lo, hi
        lo = hi


def as_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(texts: list[str]):
    """Of each text but the last, which is only the next one of the one before: the columns of PRINTS behind the keys."""
    changed = [edited(*two) for two in zip(texts, texts[1:], strict=False)]
    codes = [as_codes(t) for t in [*texts, *changed]]
    off = np.append(0, np.cumsum([len(c) for c in codes]))
    at = Prefixes(np.concatenate(codes))
    found, m = prints(at, off), len(changed)
    own, following, other = np.arange(m), np.arange(m) + 1, np.arange(m) + m + 1
    n = np.diff(off)
    reach = lambda x: at.extension(off[own], off[x], np.minimum(n[own], n[x]))
    shown = found.shown()
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    return n[:m], digests, shown[:m], shown[m + 1 :], found[own].likeness(found[other]), found[own].likeness(found[following]), reach(other), reach(following)


# ---------------------------------------------------------------- order


def places(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The first cut (ascending, 2 x cuts) that is not below each row (2 x rows): the row's range."""
    m, n = cuts.shape[1], rows.shape[1]
    order = np.lexsort((np.arange(m + n) < m, *np.concatenate([cuts, rows], 1)[::-1]))
    is_cut, out = order < m, np.empty(n, np.int64)
    out[order[~is_cut] - m] = np.cumsum(is_cut)[~is_cut]
    return out


def placed(batches, cuts: np.ndarray):
    """Rows with their range; the row that begins a range (its cut) goes also to the range whose documents come before."""
    m = cuts.shape[1]
    for batch in batches:
        rows = np.stack([batch["k"].to_numpy(), batch["h"].to_numpy()])
        part = places(rows, cuts)
        first = np.flatnonzero((cuts[:, part] == rows).all(0))
        no = pa.array(np.zeros(len(part), bool))
        own = [batch["doc_id"], batch["k"], batch["h"], text_column(batch["text"])]
        yield arrow(PLACED, *own, no, part.astype(np.int32))
        if len(first):
            yield arrow(PLACED, *(c.take(pa.array(first)) for c in own), pa.array(np.ones(len(first), bool)), ((part[first] + 1) % m).astype(np.int32))


def printed(batches):
    """A range's rows, followers last, in descending order: the columns of PRINTS for all but the followers."""
    keys: list[tuple] = []  # doc_id, k, h
    times: list[int] = []
    texts: list[str] = []
    held = 0

    def done():
        nonlocal held
        columns = compared(texts)
        rows = np.repeat(np.arange(len(texts) - 1), times[:-1])
        doc_id, k, h = zip(*keys[:-1], strict=True)
        columns = [pa.array(c, f.type) for c, f in zip((doc_id, k, h, *columns), PRINTS, strict=True)]
        for lo in range(0, len(rows), 1 << 12):
            yield arrow(PRINTS, *(c.take(pa.array(rows[lo : lo + (1 << 12)])) for c in columns))
        keys[:-1], times[:-1], texts[:-1] = [], [], []
        held = len(texts[0])

    ended = False
    for batch in batches:
        for doc_id, k, h, text, follows in zip(*(batch[c].to_pylist() for c in ("doc_id", "k", "h")), text_column(batch["text"]), batch["follows"].to_pylist(), strict=True):
            if follows and ended:
                continue
            ended = follows
            if not follows and keys and keys[-1][1:] == (k, h):
                times[-1] += 1
                continue
            keys.append((doc_id, k, h)), times.append(1), texts.append(text.as_py())
            held += len(texts[-1])
            if held > PASS and len(texts) > 1:
                yield from done()
    if len(texts) > 1:
        yield from done()


def sampled_cuts(sample: pa.Table, top: tuple[int, int], n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """2 x (n at most) ascending keys that end ranges of about equal bytes, the last one top; and keys that hold more than a range."""
    rows = np.stack([sample["k"].to_numpy(), sample["h"].to_numpy()])
    order = np.lexsort(rows[::-1])
    upto = np.cumsum(sample["bytes"].to_numpy()[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n) if len(upto) else np.empty(0, int)
    chosen = [tuple(x) for x in rows[:, order[at[at < len(order)]]].T.tolist()]
    cuts = sorted({*chosen, top})
    return np.array(cuts, np.int64).T, sorted({x for x in chosen if chosen.count(x) > 1})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; prefix_edited, prefix_next: code points that the text shares with the beginning of each."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = keyed(scanned(docs))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    whole = rows.agg(F.sum(size).alias("bytes"), F.max(F.struct("k", "h")).alias("top")).first()
    out = [c for c in PRINTS.names if c not in ("k", "h")]
    if whole["top"] is None:
        return spark.createDataFrame([], SHAPE).select(*out)
    rate = SAMPLED * n / whole["bytes"]
    drawn = rows.select("k", "h", F.greatest(size.cast("double"), F.lit(1 / rate)).alias("bytes")).where(F.rand(11) < size * rate)
    cuts, hot = sampled_cuts(drawn.toArrow(), tuple(whole["top"]), n)
    some = rows
    if hot:  # a row that fills a range or more goes once: there are fewer of them than ranges
        often = F.broadcast(spark.createDataFrame(hot, "k long, h long"))
        one = rows.join(often, ["k", "h"], "left_semi").groupBy("k", "h").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        some = rows.join(often, ["k", "h"], "left_anti").unionByName(one)
    some = some.select("doc_id", "k", "h", "text")
    dealt = some.mapInArrow(lambda it: placed(it, cuts), "doc_id long, k long, h long, text string, follows boolean, part int")
    laid = dealt.repartitionById(cuts.shape[1], F.col("part")).sortWithinPartitions("follows", F.desc("k"), F.desc("h"))
    found = laid.select("doc_id", "k", "h", "text", "follows").mapInArrow(printed, SHAPE)
    if not hot:
        return found.select(*out)
    found = settle(found)
    again = rows.select("doc_id", "k", "h").join(F.broadcast(found.join(often, ["k", "h"], "left_semi").drop("doc_id")), ["k", "h"])
    return found.join(often, ["k", "h"], "left_anti").select(*out).unionByName(again.select(*out))
