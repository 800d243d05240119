"""Operator 3, packing along a space-filling curve.

Each document's hashed byte-trigram counts are projected to four dimensions
(fixed signs), which give a Hilbert key. Documents are range-sorted by that key
(then k and h): a sample drawn by bytes, of some SAMPLED rows for each
partition, gives ranges of about equal bytes, however dense the curve is
somewhere. Each range is tokenised once and laid end to end, so neighbours
along the curve share sequences. A sequence holds ``length`` tokens; what is
left at a partition's end is cut into sequences of powers of two, so nothing is
padded.

Token ids are those of the tokenizer file, a parameter.

Defined results: null text is empty (its end token stays); every row of
repeated rows is packed, side by side (ties of curve key, doc_id and text keep
no order among them, and spread over partitions only where they fill several);
null doc_id stays null and comes first; texts may have any length and docs any
other columns; an empty table gives no piece.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import BLOCK_BYTES, arrow, blocks, keyed, mix, partitions, raw, scanned, text_column

DIMS, LEVELS = 4, 10
#: Sampled rows for each partition that set the ranges: bounds what reaches the driver by the number of partitions.
SAMPLED = 100
CODES = 1 << 16
PLACED = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("text", pa.large_string()), ("curve", pa.int64()), ("part", pa.int32())])
DRAWN = pa.schema([("curve", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("bytes", pa.float64())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.large_binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Hilbert key of each row of integer cells below 2^levels: gray-code unrotation from the top bit down, then bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (levels - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (levels - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def signs() -> np.ndarray:
    """A fixed random bit per code and dimension, two dimensions in the halves of a word each."""
    bits = np.random.default_rng(7).integers(0, 2, (CODES, DIMS), dtype=np.int64)
    return np.ascontiguousarray((bits[:, ::2] | bits[:, 1::2] << 32).T)


def curve_keys(buf: np.ndarray, off: np.ndarray, to: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    if len(buf) < 3:
        return hilbert(np.full((n, DIMS), ((1 << LEVELS) - 1) // 2))
    wide = buf.astype(np.uint16)
    codes = wide[:-2] * np.uint16(40503) + wide[1:-1] * np.uint16(2971) + wide[2:]
    count = np.maximum(np.diff(off) - 2, 0)
    mean = np.zeros((n, DIMS))
    lo = np.minimum(off[:-1], len(codes))
    hi = np.minimum(lo + count, len(codes))
    for d, word in enumerate(to):
        sums = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(word[codes], out=sums[1:])
        own = sums[hi] - sums[lo]
        mean[:, 2 * d], mean[:, 2 * d + 1] = own & 0xFFFFFFFF, own >> 32
    mean = 2 * mean / np.maximum(count, 1)[:, None] - (count > 0)[:, None]
    return hilbert(((np.tanh(10 * mean) + 1) / 2 * ((1 << LEVELS) - 1)).astype(np.int64))


#: Added to a text's bytes: what a row costs besides.
ROW_BYTES = 64


def keys_of(batches):
    """Per slice of the batches: the slice, its curve keys, its rows' bytes."""
    to = signs()
    for batch in batches:
        buf, off = raw(batch["text"])
        for lo, hi in blocks(off):
            yield batch.slice(lo, hi - lo), curve_keys(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], to), np.diff(off[lo : hi + 1]) + ROW_BYTES


def drawn(batches, rate: float):
    """Rows drawn with a chance of rate times their bytes (by a hash), and the bytes that each stands for."""
    for batch, curve, size in keys_of(batches):
        k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
        u = mix(mix(h.view(np.uint64) + np.uint64(77)) ^ k.view(np.uint64)) / 2.0**64
        i = np.flatnonzero(u < size * rate)
        if len(i):
            yield arrow(DRAWN, curve[i], k[i], h[i], np.maximum(size[i], 1 / rate))


def bounds(sample: pa.Table, n: int) -> np.ndarray:
    """3 x (n - 1 at most): the (curve, k, h) where the second and each further range of equal bytes begins."""
    rows = np.stack([sample[c].to_numpy() for c in ("curve", "k", "h")]) if sample.num_rows else np.zeros((3, 0), np.int64)
    order = np.lexsort(rows[::-1])
    upto = np.cumsum(sample["bytes"].to_numpy()[order])
    if not len(upto):
        return rows
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return rows[:, order[at[at < len(order)]]]


def ranges(rows: np.ndarray, cuts: np.ndarray, turn: int) -> np.ndarray:
    """The range of each row (3 x rows) between the cuts. Rows equal to several cuts fill all ranges between these, dealt in turn."""
    m, n = cuts.shape[1], rows.shape[1]
    both = np.concatenate([cuts, rows], 1)
    order = np.lexsort((np.arange(m + n) >= m, *both[::-1]))
    right = np.empty(n, np.int64)
    is_cut = order < m
    right[order[~is_cut] - m] = np.cumsum(is_cut)[~is_cut]
    if not m:
        return right
    new = np.ones(m, bool)
    new[1:] = (cuts[:, 1:] != cuts[:, :-1]).any(0)
    first = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    last = np.maximum(right - 1, 0)
    wide = np.where((right > 0) & (cuts[:, last] == rows).all(0), last - first[last], 0)
    return right - (turn + np.arange(n)) % (wide + 1)


def placed(batches, cuts: np.ndarray):
    turn = 0
    for batch, curve, _ in keys_of(batches):
        rows = np.stack([curve, batch["k"].to_numpy(), batch["h"].to_numpy()])
        yield arrow(PLACED, *(batch[c] for c in ("doc_id", "k", "h")), text_column(batch["text"]), curve, ranges(rows, cuts, turn).astype(np.int32))
        turn += batch.num_rows


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Token ids of whole texts under a byte-level BPE file: the same merges run by tiktoken, which is several times
    faster. Texts with the file's special token, very long ones, and all texts of a file that splits words otherwise,
    go to the tokenizers library itself, which is loaded when the first one comes."""

    #: The pre-tokenising step of such files, and the pattern that it stands for.
    SPLITS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONGEST = 1 << 20

    def __init__(self, path: str, longest: int = LONGEST) -> None:
        self.path, self.longest, self.whole, self.fast = path, longest, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], spec["pre_tokenizer"] or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] == "BPE" and plain and spec["normalizer"] is None and {x: splits.get(x) for x in self.SPLITS} == self.SPLITS:
            import tiktoken

            byte = byte_symbols()
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        if self.fast is None or len(text) > self.longest or any(t in text for t in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def pack(batches, path: str, length: int, end_id: int):
    from pyspark import TaskContext

    encode, end = Tokens(path), np.array([end_id], "<u4").tobytes()
    sequence, fill = TaskContext.get().partitionId() << 36, 0
    ready, open_, ready_bytes = [], [], 0
    for batch in batches:
        texts, ids = text_column(batch["text"]), batch["doc_id"].to_pylist()
        _, off = raw(texts)
        for lo, hi in blocks(off):
            for doc_id, text in zip(ids[lo:hi], texts.slice(lo, hi - lo), strict=True):
                tokens = encode(text.as_py()) + end
                n, at = len(tokens) // 4, 0
                while at < n:
                    take = min(length - fill, n - at)
                    open_.append((doc_id, at, take, tokens[4 * at : 4 * (at + take)], n, sequence, fill))
                    at, fill, ready_bytes = at + take, fill + take, ready_bytes + 4 * take
                    if fill == length:
                        ready += open_
                        open_, fill, sequence = [], 0, sequence + 1
            if ready_bytes > 4 * BLOCK_BYTES and ready:
                yield arrow(PIECES, *zip(*ready, strict=True))
                ready, ready_bytes = [], 0
    sizes = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
    left, used = (sizes.pop(0) if sizes else 0), 0
    for doc_id, start, n, tokens, total, _, _ in open_:
        at = 0
        while at < n:
            take = min(left - used, n - at)
            ready.append((doc_id, start + at, take, tokens[4 * at : 4 * (at + take)], total, sequence, used))
            at, used = at + take, used + take
            if used == left and sizes:
                left, used, sequence = sizes.pop(0), 0, sequence + 1
    if ready:
        yield arrow(PIECES, *zip(*ready, strict=True))


def along_the_curve(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text of docs in n partitions of about equal bytes, range-sorted by (curve, k, h)."""
    rows = keyed(scanned(docs))
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES), F.lit(1))).first()[0]
    rate = SAMPLED * n / total
    cuts = bounds(rows.mapInArrow(lambda it: drawn(it, rate), "curve long, k long, h long, bytes double").toArrow(), n)
    dealt = rows.mapInArrow(lambda it: placed(it, cuts), "doc_id long, k long, h long, text string, curve long, part int")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("curve", "k", "h").select("doc_id", "text")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: one row per piece."""
    laid = along_the_curve(docs, partitions(docs.sparkSession))
    return laid.mapInArrow(lambda it: pack(it, tokenizer, length, end_id), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
