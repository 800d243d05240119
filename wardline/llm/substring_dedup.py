"""Operator 1, substring dedup: seed and extend on winnowed anchors.

Every window of ``window`` consecutive words selects one anchor: the smallest
``seed``-word hash inside it. Equal windows select equal anchors at equal
offsets, so occurrences meet on the anchor. A run of windows that select one
anchor occurrence is its *region*, the anchor extended both ways.

1. One row per anchor occurrence is range-sorted by (anchor, region, document,
   start); a hot anchor spreads over partitions. Streaming over the sorted
   rows, an occurrence whose whole region came before is a repeat. Of an
   anchor with several regions (or one cut by a partition border) the first
   occurrence of each region goes on.
2. These few are extended window by window: their window hashes (128 bits)
   are first reduced inside a block and against the windows that the task has
   met lately, so that a window of very many regions leaves each task about
   once; then they meet by hash, and all but the first occurrence of a window
   are repeats.
3. Repeated windows are merged per document into maximal ranges and cut out.

Defined results: null text has no words; rows that repeat doc_id and text
count once and get the same result (a task anchors and extends one of them, so
n such rows take steps in proportion to n); equal doc_ids with other texts are ordered
by a text hash (ties); a null doc_id comes first; fewer than ``window`` words:
nothing removed; texts may have any length and docs any other columns; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Ranges, arrow, blocks, keyed, mix, partitions, raw, text_column, word_bounds, word_hashes

ANCHORS = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
MARKS = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_())])
WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
RUNS = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.large_string(): "string", pa.string(): "string", pa.float64(): "double", pa.binary(): "binary", pa.int16(): "short", pa.large_binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of width values."""
    val, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        other, where = val[step:], at[step:]
        val, at = val[: len(other)], at[: len(other)]
        less = other < val
        val, at = np.where(less, other, val), np.where(less, where, at)
        size += step
    return at


def block_anchors(buf: np.ndarray, off: np.ndarray, window: int, seed: int):
    """Row, start, window count, anchor hash and region hash of every anchor occurrence."""
    starts, ends, doc = word_bounds(buf, off)
    n = len(starts)
    if n < window:
        return None
    valid = doc[: n - window + 1] == doc[window - 1 :]
    one = Ranges(word_hashes(buf, starts, ends, 0), 2)
    two = Ranges(word_hashes(buf, starts, ends, 1), 3)
    at = np.arange(n - seed + 1)
    grams = one.hash(at, at + seed)
    chosen = leftmost_min(grams, window - seed + 1)
    s = np.flatnonzero(valid)
    if not len(s):
        return None
    pick = chosen[s]
    new = np.ones(len(s), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    begin, anchor = s[first], pick[first]
    region = mix(two.hash(begin, begin + count + window - 1) + (anchor - begin).astype(np.uint64))
    row = doc[begin]
    base = np.searchsorted(doc, row)  # first word of the document
    return row, begin - base, count, grams[anchor], region


class Lone:
    """Lets a (k, h) through once, as far as a table of fixed size remembers: what a task does for one row holds for all that repeat it."""

    def __init__(self, size: int = 1 << 16) -> None:
        self.size, self.full, self.rows = size, np.zeros(size, bool), np.zeros((2, size), np.int64)

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
        order = np.lexsort((h, k))
        new = np.ones(len(k), bool)
        new[order[1:]] = (k[order[1:]] != k[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
        at = (mix(k.view(np.uint64) ^ h.view(np.uint64)) % np.uint64(self.size)).astype(np.int64)
        new &= ~(self.full[at] & (self.rows[0, at] == k) & (self.rows[1, at] == h))
        self.full[at[new]], self.rows[:, at[new]] = True, np.stack([k[new], h[new]])
        return batch if new.all() else batch.filter(pa.array(new))


def anchors(batches, window: int, seed: int):
    lone = Lone()
    for batch in map(lone.of, batches):
        buf, off = raw(batch["text"])
        k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
        for lo, hi in blocks(off):
            if found := block_anchors(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window, seed):
                row, s, n, anchor, region = found
                yield arrow(ANCHORS, anchor.view(np.int64), region.view(np.int64), k[lo + row], h[lo + row], s.astype(np.int32), n.astype(np.int32))


def sift(batches):
    """Rows sorted by anchor, region, k, h, s: repeats of whole regions, and the occurrences to extend window by window."""
    last = None  # anchor, region, key of the region's first occurrence
    classes, boundary, pending = 0, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, r, k, h, s, n = (batch[c].to_numpy() for c in ANCHORS.names)
        before_a, before_r = np.roll(a, 1), np.roll(r, 1)
        new_anchor, new_class = a != before_a, (a != before_a) | (r != before_r)
        new_anchor[0] = last is None or a[0] != last[0]
        new_class[0] = new_anchor[0] or r[0] != last[1]
        head = np.maximum.accumulate(np.where(new_class, np.arange(len(a)), -1))
        own = head >= 0
        fk, fh, fs = (np.where(own, x[head], 0 if last is None else last[2][i]) for i, x in enumerate((k, h, s)))
        whole = ~new_class & ~((k == fk) & (h == fh) & (s == fs))
        group = np.cumsum(new_anchor)
        total = np.bincount(group, weights=new_class).astype(int)
        total[0] += classes
        several = total >= 2
        if last is not None and boundary:
            several[0] = True
        if last is None:
            several[1] = True  # the partition's first anchor may have begun before
        if pending is not None:
            if total[0] >= 2:
                yield pending
            if total[0] >= 2 or group[-1] > 0:
                pending = None
        rep = new_class & several[group]
        end = group[-1]
        if not several[end] and (lone := np.flatnonzero(new_class & (group == end))).size:
            i = lone[0]
            pending = arrow(MARKS, k[i : i + 1], h[i : i + 1], s[i : i + 1], n[i : i + 1], [False])
        keep = np.flatnonzero(rep | whole)
        if len(keep):
            yield arrow(MARKS, k[keep], h[keep], s[keep], n[keep], whole[keep])
        boundary = boundary and (end == 0 or (last is None and end == 1))
        classes = int(total[end])
        last = (a[-1], r[-1], (fk[-1], fh[-1], fs[-1]))
    if pending is not None:
        yield pending


def merged(row: np.ndarray, s: np.ndarray, n: np.ndarray):
    """Union of the ranges [s, s + n) per row, sorted."""
    if not len(row):
        return row, s, n
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], (s + n)[order]
    span = int(e.max()) + 2
    reach = np.maximum.accumulate(row.astype(np.int64) * span + e)
    new = np.ones(len(row), bool)
    new[1:] = row[1:].astype(np.int64) * span + s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    end = reach[np.append(first[1:], len(row)) - 1] - row[first].astype(np.int64) * span
    return row[first], s[first], (end - s[first]).astype(s.dtype)


class Lately:
    """The first occurrences of windows that a task has met, in a table of fixed size where a window may oust another."""

    def __init__(self, size: int = 1 << 17) -> None:
        self.size, self.full = size, np.zeros(size, bool)
        self.rows = np.zeros((5, size), np.int64)  # w1, w2, k, h, s

    def known(self, w1: np.ndarray, w2: np.ndarray, k: np.ndarray, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether an earlier occurrence of each (distinct) window has been met; what has none is kept."""
        at = (w1.view(np.uint64) % np.uint64(self.size)).astype(np.int64)
        v1, v2, a, b, c = self.rows[:, at]
        same = self.full[at] & (v1 == w1) & (v2 == w2)
        out = same & ((a < k) | ((a == k) & ((b < h) | ((b == h) & (c < s)))))
        new = ~out
        self.full[at[new]] = True
        self.rows[:, at[new]] = np.stack([x[new] for x in (w1, w2, k, h, s.astype(np.int64))])
        return out


def extend(batches, window: int):
    """Window hashes of the marked regions; whole repeats, and repeats inside the block or of what was met lately, leave as plain ranges (w1 = w2 = null)."""
    lately, lone = Lately(), Lone()
    for batch in map(lone.of, batches):
        buf, off = raw(batch["text"])
        k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
        lists = batch["marks"]
        at = np.repeat(np.arange(len(k)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        s, n, whole = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "whole"))
        for lo, hi in blocks(off):
            part = (at >= lo) & (at < hi)
            row, ps, pn, pw = at[part] - lo, s[part], n[part], whole[part].astype(bool)
            starts, ends, doc = word_bounds(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            base = np.searchsorted(doc, np.arange(hi - lo))
            one = Ranges(word_hashes(buf[off[lo] : off[hi]], starts, ends, 0), 2)
            two = Ranges(word_hashes(buf[off[lo] : off[hi]], starts, ends, 1), 3)
            er, es, en = row[~pw], ps[~pw], pn[~pw]
            wr = np.repeat(er, en)
            ws = np.repeat(es, en) + np.arange(en.sum()) - np.repeat(np.cumsum(en) - en, en)
            g = base[wr] + ws
            w1, w2 = one.hash(g, g + window).view(np.int64), two.hash(g, g + window).view(np.int64)
            order = np.lexsort((ws, h[lo + wr], k[lo + wr], w2, w1))
            wr, ws, w1, w2 = wr[order], ws[order], w1[order], w2[order]
            new = np.ones(len(wr), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(wr)), 0)) if len(wr) else np.empty(0, int)
            same = (k[lo + wr] == k[lo + wr[head]]) & (h[lo + wr] == h[lo + wr[head]]) & (ws == ws[head])
            known = ~new & ~same
            i = np.flatnonzero(new)
            known[i] = lately.known(w1[i], w2[i], k[lo + wr[i]], h[lo + wr[i]], ws[i])
            new &= ~known
            mr, ms, mn = merged(np.concatenate([row[pw], wr[known]]), np.concatenate([ps[pw], ws[known]]).astype(np.int64), np.concatenate([pn[pw], np.ones(known.sum(), pn.dtype)]).astype(np.int64))
            if len(mr):
                none = pa.nulls(len(mr), pa.int64())
                yield arrow(WINDOWS, none, none, k[lo + mr], h[lo + mr], ms.astype(np.int32), mn.astype(np.int32))
            if new.any():
                wr, ws = wr[new], ws[new]
                yield arrow(WINDOWS, w1[new], w2[new], k[lo + wr], h[lo + wr], ws.astype(np.int32), np.ones(len(wr), np.int32))


def later(batches):
    """Rows sorted by w1, w2, k, h, s (nulls first): plain ranges, and every occurrence of a window but the first."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        plain = batch["w1"].is_null().to_numpy(zero_copy_only=False)
        if plain.any():
            yield arrow(RUNS, *(batch[c].filter(pa.array(plain)) for c in RUNS.names))
            batch = batch.filter(pa.array(~plain))
            if not batch.num_rows:
                continue
        w1, w2, k, h, s, n = (batch[c].to_numpy() for c in WINDOWS.names)
        new = (w1 != np.roll(w1, 1)) | (w2 != np.roll(w2, 1))
        new[0] = last is None or w1[0] != last[0] or w2[0] != last[1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(w1)), -1))
        fk, fh, fs = (np.where(head >= 0, x[head], 0 if last is None else last[i + 2]) for i, x in enumerate((k, h, s)))
        keep = np.flatnonzero(~new & ~((k == fk) & (h == fh) & (s == fs)))
        if len(keep):
            yield arrow(RUNS, k[keep], h[keep], s[keep], n[keep])
        last = (w1[-1], w2[-1], fk[-1], fh[-1], fs[-1])


def cut(batches, window: int):
    for batch in batches:
        texts, ids, lists = text_column(batch["text"]), batch["doc_id"], batch["runs"]
        buf, off = raw(texts)
        flat = lists.flatten()
        s, n = flat.field("s").to_numpy(), flat.field("n").to_numpy()
        at = np.repeat(np.arange(len(off) - 1), np.diff(lists.offsets.to_numpy()))
        row, s, n = merged(at, s.astype(np.int64), n.astype(np.int64) + window - 1)
        lead = np.searchsorted(row, np.arange(len(off)))
        for lo, hi in blocks(off, 8 * (1 << 20)):
            total, gone, kept = [], [], []
            for i in range(lo, hi):
                words = buf[off[i] : off[i + 1]].tobytes().split()
                total.append(len(words))
                for j in range(lead[i + 1] - 1, lead[i] - 1, -1):
                    del words[s[j] : s[j] + n[j]]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield arrow(KEPT, ids.slice(lo, hi - lo), total, gone, kept)


def substring_dedup(docs: DataFrame, window: int = 20, seed: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: docs without the words of windows that also start earlier."""
    texts = keyed(docs)
    part = texts.drop("doc_id")
    rows = part.mapInArrow(lambda it: anchors(it, window, seed), ddl(ANCHORS))
    n = partitions(docs.sparkSession)
    by = ["anchor", "region", "k", "h", "s"]
    marks = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(sift, ddl(MARKS))
    marks = marks.groupBy("k", "h").agg(F.collect_set(F.struct("s", "n", "whole")).alias("marks"))
    # doc_id comes along so that both joins read one and the same exchange of the texts
    grown = texts.join(marks, ["k", "h"]).select("doc_id", "k", "h", "text", "marks").mapInArrow(lambda it: extend(it, window), ddl(WINDOWS))
    where = F.coalesce(F.col("w1"), F.xxhash64("k", "h", "s"))
    runs = grown.repartition(n, where).sortWithinPartitions("w1", "w2", "k", "h", "s").mapInArrow(later, ddl(RUNS))
    runs = runs.groupBy("k", "h").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    none = F.array().cast("array<struct<s:int,n:int>>")
    final = texts.join(runs, ["k", "h"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return final.mapInArrow(lambda it: cut(it, window), ddl(KEPT))
