"""Operator 8, SimHash near-dedup by covering locality-sensitive hashing.

Every bit of the 64-bit fingerprint carries a vector of radius + 1 bits; for
each non-zero vector v a mask keeps the bits whose vector has odd product with
v. Any ``radius`` differing bits leave some v orthogonal to all their vectors,
whose mask drops them all: every pair within the radius agrees in some of the
2^(radius+1) - 1 tables, none is missed.

Only distinct fingerprints enter the tables. Inside a bucket the links are
verified and reduced to a spanning forest, so the edges grow with the
fingerprints and not with the square of a group. A bucket of more than SPLIT
fingerprints is not held: its rows stream through and are dealt anew by the
masks of another turn, over all partitions, until every bucket is small.
Components are contracted in tables.

Defined results: null or wordless text has fingerprint zero and links like any
other; repeated rows share their fingerprint; a null doc_id counts as the
smallest long and a component led by it has component_id null. A component is
named by its smallest doc_id, which null or repeated doc_ids may make the name
of several; its smallest fingerprint, component_fp, is its own. Of equal
doc_ids (ties) the smaller text hash leads. An empty table gives an empty
result; texts may have any length and docs any other columns.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import NULL_KEY, arrow, keyed, partitions, scanned, settle, text_column, whole_rows
from wardline.llm.components import components

BITS = 64
PRINTS = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])
#: A link of fingerprints u and v (t = -1), or fingerprint u of the too large bucket v of table t.
LINKS = pa.schema([("t", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])
#: A bucket above this is split by more masks before its pairs are compared.
SPLIT = 2048
#: Turns of masks: what agrees in one mask of each of four turns has too few free bits for a large bucket.
TURNS = 4


def fingerprint(text: str, size: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(last)
    count = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):
        h = np.array([digest(flat[a:b], 42) for a, b in zip(starts[lo : lo + (1 << 16)].tolist(), last[lo : lo + (1 << 16)].tolist(), strict=False)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def prints(batches, size: int):
    for batch in batches:
        fps = [fingerprint(t.as_py(), size) for t in text_column(batch["text"])]
        yield arrow(PRINTS, batch["doc_id"], batch["k"], batch["h"], np.array(fps, np.uint64).view(np.int64))


def masks(radius: int, turn: int = 0) -> list[int]:
    """The covering masks; another turn deals the vectors to the bits anew."""
    n = 2 ** (radius + 1) - 1
    vector = [(i * (6 * turn + 1) + 11 * turn) % BITS % n + 1 for i in range(BITS)]
    return [sum(((vector[i] & v).bit_count() & 1) << i for i in range(BITS)) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give joined nodes the smallest label of both, in place."""
    while len(u):
        a, b = label[u], label[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        open_ = lo != hi
        if not open_.any():
            break
        u, v, lo, hi = u[open_], v[open_], lo[open_], hi[open_]
        np.minimum.at(label, hi, lo)
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def link(batches, radius: int, split: int):
    """Rows sorted by table and key: a spanning forest of the links inside each bucket, and the rows of buckets above split."""
    rest, large = None, None
    for batch in _ended(batches):
        t, key, fp = (batch[c].to_numpy() for c in ("t", "key", "fp"))
        if rest is not None:
            t, key, fp = (np.concatenate(x) for x in zip(rest, (t, key, fp), strict=True))
            rest = None
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(t)))
        over = size > split
        if len(t) and large == (t[0], key[0]):
            over[0] = True
        large = (t[-1], key[-1]) if len(t) and over[-1] else None
        if batch.num_rows and not over[-1]:  # the last bucket may go on
            cut = first[-1]
            rest = t[cut:], key[cut:], fp[cut:]
            t, key, fp, first, size, over = t[:cut], key[:cut], fp[:cut], first[:-1], size[:-1], over[:-1]
        if not len(t):
            continue
        if over.any():
            out = np.repeat(over, size)
            yield arrow(LINKS, t[out], fp[out], key[out])
        fp = fp.view(np.uint64)
        group = np.repeat(np.arange(len(size)), size)
        label = np.arange(len(t))
        small = size[group] <= 32
        for d in range(1, int(min(32, size.max()))):
            i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
            near = np.bitwise_count(fp[i] ^ fp[i + d]) <= radius
            unite(label, i[near], i[near] + d)
        for g in np.flatnonzero((size > 32) & ~over):
            link_all(fp, radius, label, np.arange(first[g], first[g] + size[g]))
        other = np.flatnonzero(label != np.arange(len(t)))
        if len(other):
            yield arrow(LINKS, np.full(len(other), -1, np.int32), fp.view(np.int64)[label[other]], fp.view(np.int64)[other])


def link_all(fps: np.ndarray, radius: int, label: np.ndarray, nodes: np.ndarray) -> None:
    """Unite all pairs within the radius among fps[nodes], of which there are at most SPLIT."""
    for lo in range(0, len(nodes), 256):
        rows = nodes[lo : lo + 256]
        near = np.bitwise_count(fps[rows, None] ^ fps[None, nodes[lo:]]) <= radius
        i, j = np.nonzero(near)
        unite(label, rows[i], nodes[lo + j])


def _ended(batches):
    """The batches, then an empty one."""
    last = None
    for last in batches:
        if last.num_rows:
            yield last
    if last is not None:
        yield last.slice(0, 0)


def masked(fp, radius: int, turn: int) -> list:
    return [fp.bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks(radius, turn)]


def links(nodes: DataFrame, radius: int, rows: int, split: int) -> DataFrame:
    """u, v: links that connect what lies within the radius. nodes: distinct fp, at most rows of them."""
    n, fp = partitions(nodes.sparkSession), F.col("fp")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), key.alias("key")) for t, key in enumerate(masked(fp, radius, 0))])
    dealt, found = nodes.select("fp", F.explode(keys).alias("x")).select("x.t", "x.key", "fp"), []
    for turn in range(1, TURNS + 1):
        most = split if turn < TURNS else 1 << 62
        dealt = dealt.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp")
        out = settle(dealt.mapInArrow(lambda it, most=most: link(it, radius, most), "t int, u long, v long"), rows * (2 ** (radius + 1) - 1))
        found.append(out.where("t < 0").select("u", "v"))
        large = out.where("t >= 0")
        if not large.limit(1).count():
            break
        rest = large.select("t", F.col("v").alias("key"), F.col("u").alias("fp"))
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.xxhash64("t", "key", key).alias("key")) for i, key in enumerate(masked(fp, radius, turn))])
        dealt = rest.select("fp", F.explode(keys).alias("x")).select("x.t", "x.key", "fp")
    return reduce(DataFrame.union, found)


def grouped(docs: DataFrame, size: int, radius: int, split: int = SPLIT) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, k, h, fp of every row of docs; fp, component (its smallest fp) of every fingerprint; the number of rows.

    Fingerprints are the nodes: rows that only share a doc_id, or have none, are not linked by it.
    """
    own = settle(keyed(scanned(docs)).mapInArrow(lambda it: prints(it, size), "doc_id long, k long, h long, fp long"))
    nodes, rows = own.select("fp").distinct(), own.count()
    found = components(links(nodes, radius, rows, split), rows)
    return own, nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component")), rows


def simhash_groups(docs: DataFrame, size: int = 4, radius: int = 4, split: int = SPLIT) -> DataFrame:
    """doc_id, fp (signed long), component_id, component_fp: documents linked through fingerprints within radius bits."""
    own, group, rows = grouped(docs, size, radius, split)
    group = settle(own.groupBy("fp").agg(F.min("k").alias("k")).join(group, "fp"), rows)
    lead = settle(group.groupBy("component").agg(F.min("k").alias("lead")), rows)
    out = own.drop("k").join(group.join(lead, "component").select("fp", "component", "lead"), "fp")
    return out.select("doc_id", "fp", F.when(F.col("lead") != NULL_KEY, F.col("lead")).alias("component_id"), F.col("component").alias("component_fp"))


def keep_first(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs that lead their group (its smallest doc_id, then text hash; of repeated rows one), unchanged."""
    own, group, rows = grouped(docs, size, radius)
    first = own.groupBy("fp", "k", "h").count().groupBy("fp").agg(F.min(F.struct("k", "h", "count")).alias("x"))
    lead = first.join(group, "fp").groupBy("component").agg(F.min("x").alias("x"))
    lead = settle(lead.select("x.k", "x.h", F.col("x.count").alias("n")), rows)
    kept = whole_rows(docs).join(lead, ["k", "h"])
    if lead.where("n > 1").limit(1).count():
        kept = kept.where("n = 1").union(kept.where("n > 1").dropDuplicates(["k", "h"]))
    return kept.select("row.*")
