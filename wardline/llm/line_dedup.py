"""Operator 6, line dedup: a sharded minimal perfect hash over distinct line hashes.

1. Every document gives its distinct long line hashes (128 bits). Counted per
   hash (partial sums before the shuffle): documents and largest doc_id.
2. All distinct hashes are dealt to shards of some SHARD_KEYS keys. Each shard
   holds a minimal perfect hash (levels of bit arrays with ranks) over its
   hashes that indexes compact arrays: a 32-bit fingerprint and a document
   count each, and the largest doc_id of those that reach ``min_docs``.
3. The documents' hashes go to the shards and probe the arrays: no join of
   lines. The counts decide. A shard that many probes ask (a hot line or
   source) is copied to several salts, by its number of probes; a task holds
   one copy at a time while its probes stream past.
4. The hits are gathered per document and its lines dropped.

Every probe is a key of the index, so the fingerprint is a guard only and 32
bits do.

Defined results: null or empty text is one empty line; "documents" counts
distinct doc_ids (null is one, and the smallest); repeated rows of the largest
doc_id all keep their lines; an empty table gives an empty result; whatever
other columns there are stay as they are.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import SPACES, arrow, keyed, mix, partitions, pieces, scanned, settle, text_column, whole_rows

SHARD_KEYS = 1 << 13
FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64()), ("h", pa.int64())])
INDEX = pa.schema([("shard", pa.int64()), ("arrays", pa.binary())])
HITS = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.large_string())])


def line_hash(line: str, min_chars: int) -> bytes | None:
    """Hash of the line's key (stripped, A-Z lower-cased), or None for a short one."""
    key = line.strip(SPACES)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def find(batches, min_chars: int):
    for batch in pieces(batches):
        k, h = batch["k"].to_numpy(), batch["h"].to_numpy()
        got, row = [], []
        for i, text in enumerate(text_column(batch["text"])):
            own = {x for x in (line_hash(line, min_chars) for line in text.as_py().split("\n")) if x}
            got += own
            row += [i] * len(own)
        if row:
            both = np.frombuffer(b"".join(got), "<i8").reshape(-1, 2)
            yield arrow(FOUND, both[:, 0].copy(), both[:, 1].copy(), k[row], h[row])


# ------------------------------------------------- minimal perfect hash


def level_hash(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix(a + mix(b + np.uint64(level * 0x9E3779B9 + 1)))


def build(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Bit words and ranks of each level for distinct keys (a, b); about 3 bits a key in all."""
    out, rank, level = [], 0, 0
    while len(a):
        size = max(64, 2 * len(a) + 63 & ~63)
        at = level_hash(a, b, level) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        words = np.packbits(alone, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        out += [words, rank + np.cumsum(ones) - ones]
        rank += int(ones.sum())
        left = ~alone[at.astype(np.int64)]
        a, b, level = a[left], b[left], level + 1
    return out


def slots(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slot of each key; of a foreign key any slot, or -1."""
    out = np.full(len(a), -1, np.int64)
    open_ = np.arange(len(a))
    for level in range(len(levels) // 2):
        words, ranks = levels[2 * level], levels[2 * level + 1]
        at = (level_hash(a[open_], b[open_], level) % np.uint64(64 * len(words))).astype(np.int64)
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[open_[hit]] = ranks[at[hit] >> 6] + below[hit]
        open_ = open_[~hit]
    return out


MOST_COUNT = 2**32 - 1


def shard_arrays(rows: pa.Table, min_docs: int) -> pa.Table:
    a, b = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    levels = build(a, b)
    slot = slots(levels, a, b)
    print_, count, last = np.empty(len(a), np.uint32), np.empty(len(a), np.uint32), np.empty(len(a), np.int64)
    print_[slot], count[slot], last[slot] = b.astype(np.uint32), np.minimum(rows["n_docs"].to_numpy(), MOST_COUNT), rows["last"].to_numpy()
    often = np.flatnonzero(count >= min_docs).astype(np.uint32)
    np.savez(to := io.BytesIO(), print=print_, count=count, often=often, last=last[often], **{f"level{i:03}": x for i, x in enumerate(levels)})
    return pa.Table.from_batches([arrow(INDEX, [rows["shard"][0].as_py()], [to.getvalue()])])


class Shard:
    def __init__(self, arrays: bytes) -> None:
        x = np.load(io.BytesIO(arrays))
        self.levels = [x[n] for n in sorted(x.files) if n.startswith("level")]
        self.print, self.count, self.often, self.last = x["print"], x["count"], x["often"], x["last"]

    def lost(self, a: np.ndarray, b: np.ndarray, k: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether a document k loses the lines of hash (a, b)."""
        at = slots(self.levels, a, b)
        known = np.flatnonzero(at >= 0)
        known = known[(self.print[at[known]] == b[known].astype(np.uint32)) & (self.count[at[known]] >= min_docs)]
        out = np.zeros(len(a), bool)
        out[known] = self.last[np.searchsorted(self.often, at[known])] != k[known]
        return out


def probe(batches, min_docs: int):
    """Rows sorted by shard, salt and kind: a shard's arrays come first, then the probes that use them."""
    shard, at = None, None
    for batch in batches:
        place = np.stack([batch["shard"].to_numpy(), batch["salt"].to_numpy()], 1)
        kind = batch["kind"].to_numpy()
        k, h, h1, h2 = (batch[c].to_numpy() for c in HITS.names)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(1) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if lo == hi:
                continue
            if kind[lo] == 0:
                shard, at = Shard(batch["arrays"][lo].as_py()), tuple(place[lo])
            elif at == tuple(place[lo]):
                hit = lo + np.flatnonzero(shard.lost(h1[lo:hi].view(np.uint64), h2[lo:hi].view(np.uint64), k[lo:hi], min_docs))
                if len(hit):
                    yield arrow(HITS, k[hit], h[hit], h1[hit], h2[hit])


def kept_lines(text: str, lost: set[bytes], min_chars: int) -> tuple[int, int, str]:
    """Lines before, lines dropped, the text that stays."""
    lines = text.split("\n")
    if not lost:
        return len(lines), 0, text
    kept = [x for x in lines if line_hash(x, min_chars) not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def cut(batches, min_chars: int):
    """A slice at a time: its rows, and (lines, dropped, kept text) of each."""
    for batch in pieces(batches):
        texts, lists = text_column(batch["text"]), batch["lost"]
        off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        both = np.stack([flat.field("h1").to_numpy(), flat.field("h2").to_numpy()], 1).astype("<i8").tobytes()
        lost = ({both[16 * j : 16 * j + 16] for j in range(off[i], off[i + 1])} for i in range(len(texts)))
        yield batch, [kept_lines(t.as_py(), x, min_chars) for t, x in zip(texts, lost, strict=True)]


def as_kept(batches, min_chars: int):
    for batch, rows in cut(batches, min_chars):
        yield arrow(KEPT, batch["doc_id"], *zip(*rows, strict=True))


def as_rows(batches, min_chars: int):
    for batch, rows in cut(batches, min_chars):
        text = pa.array([None if null else r[2] for r, null in zip(rows, batch["text"].is_null().to_pylist(), strict=True)], pa.large_string())
        yield pa.RecordBatch.from_arrays([batch["row"], text], names=["row", "kept"])


def lost_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """k, h and lost: the line hashes that a document loses; only documents that lose any."""
    spark = docs.sparkSession
    found = settle(keyed(scanned(docs)).drop("doc_id").mapInArrow(lambda it: find(it, min_chars), "h1 long, h2 long, k long, h long"))
    lines = settle(found.groupBy("h1", "h2").agg(F.count_distinct("k").alias("n_docs"), F.max("k").alias("last")), found.count())
    size = lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("probes")).first()
    shards, n = max(1, math.ceil(size["lines"] / SHARD_KEYS)), partitions(spark)
    shard = F.expr(f"pmod(h1, {shards}L)").cast("long").alias("shard")
    # shards of more probes than a partition's share get a copy for each share of theirs; there are less than n of them
    share = max(1, size["probes"] // n)
    hot = lines.groupBy(shard).agg(F.sum("n_docs").alias("probes")).where(F.col("probes") > share)
    hot = F.broadcast(hot.select("shard", F.ceil(F.col("probes") / share).alias("copies")))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    index = lines.select(shard, "h1", "h2", "n_docs", "last").groupBy("shard").applyInArrow(lambda rows: shard_arrays(rows, min_docs), "shard long, arrays binary")
    none = F.lit(0).cast("long")
    index = index.join(hot, "shard", "left").select("shard", F.explode(F.sequence(none, copies - 1)).alias("salt"), F.lit(0).alias("kind"), none.alias("k"), none.alias("h"), none.alias("h1"), none.alias("h2"), "arrays")
    probes = found.select(shard, "k", "h", "h1", "h2").join(hot, "shard", "left")
    probes = probes.select("shard", F.pmod(F.xxhash64("k", "h"), copies).alias("salt"), F.lit(1).alias("kind"), "k", "h", "h1", "h2", F.lit(None).cast("binary").alias("arrays"))
    dealt = index.union(probes).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    hits = dealt.mapInArrow(lambda it: probe(it, min_docs), "k long, h long, h1 long, h2 long")
    return hits.groupBy("k", "h").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


NONE_LOST = "array<struct<h1:long,h2:long>>"


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: docs without frequent long lines, which stay in the largest doc_id only."""
    lost = lost_lines(docs, min_chars, min_docs)
    whole = keyed(docs).join(lost, ["k", "h"], "left").select("doc_id", "text", F.coalesce("lost", F.array().cast(NONE_LOST)).alias("lost"))
    return whole.mapInArrow(lambda it: as_kept(it, min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")


def line_dedup_rows(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the kept lines as text (null stays null); all other columns as they are."""
    text = F.col("text").cast("string")
    others = [c for c in docs.columns if c != "text"]
    rows = whole_rows(docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "doc_id", text.alias("text")))
    whole = rows.join(lost_lines(docs, min_chars, min_docs), ["k", "h"], "left")
    whole = whole.select(F.col("row.row").alias("row"), F.col("row.text").alias("text"), F.coalesce("lost", F.array().cast(NONE_LOST)).alias("lost"))
    kept = whole.mapInArrow(lambda it: as_rows(it, min_chars), T.StructType([whole.schema["row"], T.StructField("kept", T.StringType())]))
    return kept.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
