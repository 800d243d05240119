"""Shared plumbing of the training-data operators: tables, shared storage, Arrow text buffers, hashing.

Documents are keyed by ``(k, h)``: ``k`` is doc_id as a long (null counts as the
smallest long) and ``h`` a 64-bit hash of the text, so rows that repeat a doc_id
and text count once and rows that share only the doc_id (or have none) stay apart.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Smallest long: what a null doc_id is ordered and joined as.
NULL_KEY = -(2**63)
#: The ASCII white space of every contract here, as characters.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one numpy pass takes (documents stay whole, a longer one forms its own pass).
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, a temporary one in local mode, an error on a cluster: its machines share no local folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='wardline-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


#: Rows of a settled table that one file takes, where their number is known.
FILE_ROWS = 100_000
#: Bytes of input that one scan task takes at least, where there are more tasks than cores can use.
SCAN_BYTES = 32 << 20


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage. rows: about how many its last stage reads, so that a small table is not spread over many files."""
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, min(partitions(df.sparkSession), rows // FILE_ROWS + 1)))
    return df.checkpoint(eager=True)


def scanned(docs: DataFrame) -> DataFrame:
    """docs in fewer partitions where these are many and small (by the plan's own estimate of its bytes): a scan of tiny files makes no tiny files again."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.coalesce(max(4 * spark.sparkContext.defaultParallelism, min(size // SCAN_BYTES, 1 << 30)))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, k, h, text: only what the operators need, whatever else docs holds."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
        *more,
    )


def whole_rows(docs: DataFrame, *more) -> DataFrame:
    """docs with each row as one struct ``row`` beside its key (k, h) and ``more``: whatever columns docs has, no name of the operators clashes with them.

    select("row.*") gives the rows back unchanged.
    """
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"), F.xxhash64(text).alias("h"), *more)


def once(rows: DataFrame, keys: list[str], **columns) -> DataFrame:
    """The keys of rows beside columns, made by a generator of one row.

    A later filter on one of the columns stays above the generator and does not
    evaluate the column's whole expression again; filters on keys still move
    down to the scan.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("made")
    return rows.select(*keys, made).select(*keys, "made.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow text


def text_column(col: pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a large_string array without nulls."""
    col = text_column(col)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(off):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to slices whose ``column`` holds at most limit bytes (one row at least), so that what Python makes of one stays small."""
    for batch in batches:
        _, off = raw(batch[column])
        for lo, hi in blocks(off, limit):
            yield batch.slice(lo, hi - lo)


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes (one row at least)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word [^ \\t-\\r]+ (bytes); a word never spans documents."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(190733)
_BASES = [int(x) * 2 + 1 for x in _RNG.integers(2**40, 2**62, 4)]
BYTE_CODES = [_RNG.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        steps = np.full(max(n, 1 << 18), base, np.uint64)
        steps[0] = 1
        have = _POWERS[which, inverse] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Ranges:
    """Polynomial hashes (mod 2^64, then mixed) of any range of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, which: int) -> None:
        self.which = which
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(which, len(codes), False)[: len(codes)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _powers(self.which, len(self.sums), True)
        return mix((self.sums[end] - self.sums[start]) * inv[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    return Ranges(BYTE_CODES[which][buf], which).hash(starts, ends)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return LOWER[buf]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def arrow(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
