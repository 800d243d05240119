"""Factor models trained by stochastic steps over a grid of user and item blocks.

Users and items are dealt to ``blocks`` blocks each by a hash. A sub-epoch takes
the cells of one diagonal of the grid: no two of them share a user or an item,
so each is one task that holds its cell's pairs and the factors of one user and
one item block, and no two tasks touch the same factor. ``blocks`` sub-epochs
make an epoch. The factors are a table (kind, id, vector) throughout; none of
them ever reach the driver.

A cell's pairs are taken in an order hashed from seed, epoch and ids, in
mini-batches; the negatives of a pair are drawn by a hash from the cell's own
items, so they move through no shuffle. With the same seed and blocks the
factors are the same, however Spark deals its tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.shared import settle

#: Pairs that a cell holds on average, at most, where the grid's size is chosen from their number.
CELL_PAIRS = 1_000_000
#: Draws for each negative before one is taken as it is.
TRIALS = 8
#: Pairs whose negatives are drawn at once.
DRAWN = 1 << 16
FACTORS = "kind int, id long, vector array<double>"
SCHEMA = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("vector", pa.list_(pa.float64()))])


def mixed(*parts, x=np.uint64(0x9E3779B97F4A7C15)) -> np.ndarray:
    """A 64-bit hash of equally long integer arrays (or single integers); x: of those before them."""
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p, np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(29))
            x = x * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return x


def start_vectors(seed: int, kind: int, ids: np.ndarray, size: int, spread: float) -> np.ndarray:
    """Normal values of a given spread, from a hash of seed, kind, id and dimension."""
    grid = np.stack([mixed(seed, np.full(len(ids), 2 * kind + k), ids)[:, None] + np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 1)])
    u = ((mixed(grid.view(np.int64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return spread * np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


@dataclass(frozen=True)
class Plan:
    """How to train: loss ``bpr`` (liked above unseen), ``bce`` (liked 1, unseen 0) or ``labels`` (bce of each pair's own label, nothing drawn)."""

    size: int = 16
    loss: str = "bpr"
    negatives: int = 1
    rate: float = 0.05
    decay: float = 1e-4
    spread: float = 0.1
    batch: int = 64
    seed: int = 42


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def hashed_order(key: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """The places of hashes in order; equal ones go by the ties, the first of them last."""
    order = np.argsort(key)
    in_order = key[order]
    return np.lexsort((*ties, key)) if (in_order[1:] == in_order[:-1]).any() else order


class Known:
    """Codes that are looked up: few bits of a hash answer for most that are not there."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.shift = np.uint64(64 - max(4, (8 * len(codes)).bit_length()))
        self.there = np.zeros(1 << int(64 - self.shift), bool)
        self.there[self.place(codes)] = True

    def place(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def has(self, codes: np.ndarray) -> np.ndarray:
        found = self.there[self.place(codes)]
        some = np.flatnonzero(found)
        at = np.minimum(np.searchsorted(self.codes, codes[some]), len(self.codes) - 1)
        found[some] = self.codes[at] == codes[some]
        return found


#: Batches that a cell's factors must let pass at once, on average, for its pairs to be dealt to rounds.
ROUNDS_FROM = 8


def rounds(touched: np.ndarray, batch: np.ndarray, first: np.ndarray):
    """Rows that may be trained together, round after round, with the factors of batch after batch.

    touched: rows x factors that a row reads and moves; batch: of each row, ascending; first: scratch, one number for each factor. A row is due when no
    earlier batch has a row left that touches one of its factors; rows of one batch that share a factor read it before either moves it, so they go together.
    """
    left, held = np.arange(len(batch)), np.zeros(len(first), bool)
    while len(left):
        t, own = touched[left], batch[left, None]
        first[t[::-1].ravel()] = np.repeat(own[::-1, 0], t.shape[1])  # the earliest is written last
        mine = first[t] == own
        due = mine.all(1)
        while True:
            wait = ~due
            bars = t[wait][mine[wait]]
            held[bars] = True
            late = due & held[t].any(1)
            held[bars] = False
            if not late.any():
                break
            due &= ~late
        yield left[due]
        few = 16 * due.sum() < len(left)
        left = left[~due]
        if few:  # a factor of nearly all batches: what is left goes batch by batch
            yield from np.split(left, np.flatnonzero(np.diff(batch[left])) + 1)
            return


def cell_steps(plan: Plan, epoch: int, u: np.ndarray, i: np.ndarray, label: np.ndarray, p: np.ndarray, q: np.ndarray, users: np.ndarray, items: np.ndarray) -> float:
    """One pass over a cell's pairs (places u in users, i in items), p and q updated in place; the last column of each is its bias. The loss sum.

    Where a cell has many factors, most of its batches share none: their pairs are trained in rounds, with the factors of one batch after another.
    """
    order = hashed_order(mixed(plan.seed, epoch, users[u], items[i]), items[i], users[u])
    u, i, label = u[order], i[order], label[order]
    drawn = plan.loss != "labels"
    known = Known(np.sort(u * len(items) + i)) if drawn and len(u) else None
    per = 1 + drawn * plan.negatives
    # pairs of which each meets about one earlier one that shares a factor
    apart = int(1 / (1 / max(1, len(users)) + per * per / max(1, len(items))))
    dealt = apart >= ROUNDS_FROM * plan.batch
    step = plan.batch * (max(1, min(apart, DRAWN) // plan.batch) if dealt else 1)
    many = step * max(1, DRAWN // step)
    first, seen = np.zeros(len(users) + len(items), np.int64), (np.zeros(len(users), np.int64), np.zeros(len(items), np.int64))
    total, ahead = 0.0, np.zeros((0, 0), np.int64)
    for lo in range(0, len(u), step):
        a, b, y = u[lo : lo + step], i[lo : lo + step], label[lo : lo + step]
        if lo % many == 0:  # draws rest on hashes alone, so many batches' are made at once
            ahead = negatives_of(plan, epoch, u[lo : lo + many], i[lo : lo + many], users, items, known) if drawn else np.zeros((len(u[lo : lo + many]), 0), np.int64)
        neg = ahead[lo % many : lo % many + len(a)]
        if not dealt:
            total += train_rows(plan, p, q, a, b, y, neg, seen)
            continue
        touched = np.concatenate([a[:, None], len(users) + b[:, None], len(users) + neg], 1)
        for r in rounds(touched, np.arange(len(a)) // plan.batch, first):
            total += train_rows(plan, p, q, a[r], b[r], y[r], neg[r], seen)
    return float(total)


def train_rows(plan: Plan, p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, neg: np.ndarray, seen: tuple[np.ndarray, np.ndarray]) -> float:
    """One step of pairs (a, b) of label y with their negatives, all at once; decay pulls what moves to 0. The loss sum."""
    every = np.concatenate([b[:, None], neg], 1)  # a pair's items
    own, others = p.take(a, 0), q.take(every, 0)
    s = np.einsum("ncd,nd->nc", others[:, :, :-1], own[:, :-1]) + own[:, -1:] + others[:, :, -1]
    times = np.ones(every.shape[1])  # steps that an item of a pair takes part in
    if plan.loss == "bpr":
        gap = s[:, :1] - s[:, 1:]
        loss, slope, times[0] = np.logaddexp(0, -gap).sum(), np.empty_like(s), neg.shape[1]
        slope[:, 1:] = -sigmoid(-gap)
        slope[:, 0] = -slope[:, 1:].sum(1)
    else:
        want = np.zeros_like(s)
        want[:, 0] = 1 if plan.loss == "bce" else y
        loss, slope = (np.logaddexp(0, s) - want * s).sum(), want - sigmoid(s)
    to_p, to_q = np.einsum("nc,ncd->nd", slope, others), slope[:, :, None] * own[:, None, :]
    to_p[:, -1], to_q[:, :, -1] = slope.sum(1), slope  # of the biases
    to_p -= plan.decay * times.sum() * own
    to_q -= (plan.decay * times)[None, :, None] * others
    add(p, a, plan.rate * to_p, seen[0])
    add(q, every.ravel(), (plan.rate * to_q).reshape(-1, q.shape[1]), seen[1])
    return loss


def negatives_of(plan: Plan, epoch: int, a: np.ndarray, b: np.ndarray, users: np.ndarray, items: np.ndarray, known: np.ndarray | Known) -> np.ndarray:
    """Per pair plan.negatives places of items of the cell that the user has not, as far as TRIALS draws find any."""
    known = known if isinstance(known, Known) else Known(known)
    out = np.zeros((len(a), plan.negatives), np.int64)
    pair = mixed(plan.seed, epoch, users[a], items[b])
    for k in range(plan.negatives):
        own = mixed(k, x=pair)
        open_ = np.arange(len(a))
        for t in range(TRIALS):
            x = (mixed(t, x=own[open_]) % np.uint64(len(items))).astype(np.int64)
            out[open_, k] = x
            open_ = open_[known.has(a[open_] * len(items) + x)]
            if not len(open_):
                break
    return out


def scores(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products and both biases."""
    return (p[:, :-1] * q[:, :-1]).sum(1) + p[:, -1] + q[:, -1]


def add(vectors: np.ndarray, at: np.ndarray, steps: np.ndarray, seen: np.ndarray) -> None:
    """np.add.at(vectors, at, steps), whole rows at once: the first step of each row, then the second, and so on. seen: scratch, one number for each row."""
    left = np.arange(len(at))
    while len(left):
        own = at[left]
        seen[own[::-1]] = left[::-1]  # the first is written last
        now = seen[own] == left
        if now.all():
            vectors[own] = vectors.take(own, 0) + (steps.take(left, 0) if len(left) < len(at) else steps)
            return
        vectors[own[now]] = vectors.take(own[now], 0) + steps.take(left[now], 0)
        left = left[~now]


def grid_size(pairs: int) -> int:
    return max(2, math.ceil(math.sqrt(pairs / CELL_PAIRS)))


#: Pairs of a task that are packed together.
PACKED = 1 << 20


def packed(pairs: DataFrame) -> DataFrame:
    """ub, ib, pairs: pieces of the cells, each the u, i and label of its pairs end to end, so that they move as bytes in every epoch. pairs: u, i, label, ub, ib."""

    def pieces(rows: pa.Table):
        ub, ib = rows["ub"].to_numpy(), rows["ib"].to_numpy()
        order = np.lexsort((ib, ub))
        columns = [rows["u"].to_numpy()[order], rows["i"].to_numpy()[order], rows["label"].to_numpy()[order].view(np.int64)]
        ub, ib = ub[order], ib[order]
        begin = np.flatnonzero(np.append(True, (np.diff(ub) != 0) | (np.diff(ib) != 0)))
        blobs = [np.concatenate([c[lo:hi] for c in columns]).tobytes() for lo, hi in zip(begin, np.append(begin[1:], len(ub)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ub[begin]), pa.array(ib[begin]), pa.array(blobs, pa.binary())], names=["ub", "ib", "pairs"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PACKED:
                yield pieces(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pieces(pa.Table.from_batches(held))

    return pairs.select("u", "i", "label", "ub", "ib").mapInArrow(run, "ub int, ib int, pairs binary")


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, i and label of pieces."""
    parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1) for x in column]
    u, i, label = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)
    return u, i, label.view(np.float64)


def epoch_of(pairs: DataFrame, factors: DataFrame, plan: Plan, blocks: int, epoch: int) -> DataFrame:
    """The factors after one epoch: a table settled after each sub-epoch. pairs: what packed gives."""

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kind, ids = right["kind"].to_numpy(), right["id"].to_numpy()
        flat = right["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).copy()
        order = np.lexsort((ids, kind))
        kind, ids, flat = kind[order], ids[order], flat[order]
        n = int((kind == 0).sum())
        users, items, p, q = ids[:n], ids[n:], flat[:n], flat[n:]
        if left.num_rows:
            u, i, label = unpacked(left["pairs"])
            cell_steps(plan, epoch, np.searchsorted(users, u), np.searchsorted(items, i), label, p, q, users, items)
        vectors = np.concatenate([p, q])
        off = np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1]
        return pa.Table.from_arrays([pa.array(kind, pa.int32()), pa.array(ids), pa.ListArray.from_arrays(pa.array(off), pa.array(vectors.ravel()))], schema=SCHEMA)

    for d in range(blocks):
        shift = (d + epoch) % blocks
        own = F.when(F.col("kind") == 0, block_of("id", blocks)).otherwise(F.pmod(block_of("id", blocks) - shift, F.lit(blocks)))
        due = pairs.where(F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks)) == shift)
        cells = due.groupBy(F.col("ub").alias("cell")).cogroup(factors.withColumn("cell", own).groupBy("cell"))
        factors = settle(cells.applyInArrow(cell, FACTORS))
    return factors


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(blocks)).cast("int")


def train_factors(
    pairs: DataFrame, plan: Plan, epochs: int, blocks: int | None = None, monitor: Callable[[DataFrame, DataFrame], float] | None = None, valid_every: int = 1
) -> tuple[DataFrame, list[dict]]:
    """Factors (kind 0 user or 1 item, id, vector whose last entry is a bias) and a log row (epoch, ndcg) for each watched epoch.

    pairs: u, i and, for the loss ``labels``, label; repeated pairs count once.
    monitor gets user and item factors (u, p and i, q, so that their inner
    product is the score) every valid_every epochs and at the end; the factors
    of the best epoch are returned (the earlier one wins a tie), or the last.
    """
    ids = [F.col(c).cast("long").alias(c) for c in ("u", "i")]
    label = F.max(F.col("label").cast("double")) if plan.loss == "labels" else F.lit(1.0)
    pairs = settle(pairs.groupBy(*ids).agg(label.alias("label")))
    blocks = blocks or grid_size(pairs.count())
    pairs = pairs.withColumns({"ub": block_of("u", blocks), "ib": block_of("i", blocks)})

    def started(batches):
        for batch in batches:
            kind, ids = batch["kind"].to_numpy(), batch["id"].to_numpy()
            x = np.concatenate([np.where((kind == 0)[:, None], *(start_vectors(plan.seed, k, ids, plan.size, plan.spread) for k in (0, 1))), np.zeros((len(ids), 1))], 1)
            off = np.arange(len(ids) + 1, dtype=np.int32) * (plan.size + 1)
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["id"], pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], schema=SCHEMA)

    ids = pairs.select(F.lit(0).alias("kind"), F.col("u").alias("id")).distinct().unionByName(pairs.select(F.lit(1).alias("kind"), F.col("i").alias("id")).distinct())
    factors = settle(ids.mapInArrow(started, FACTORS))
    pairs = settle(packed(pairs))
    log, best, chosen = [], -math.inf, None
    for epoch in range(1, epochs + 1):
        factors = epoch_of(pairs, factors, plan, blocks, epoch)
        if monitor and (epoch % valid_every == 0 or epoch == epochs):
            found = monitor(*sides(factors))
            log.append({"epoch": epoch, "ndcg": found})
            if found > best:
                best, chosen = found, factors
    return (factors if chosen is None else chosen), log


def sides(factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User factors (u, p) and item factors (i, q) whose inner product is the score: both biases are folded in."""
    bare, bias = F.expr("slice(vector, 1, size(vector) - 1)"), F.element_at("vector", -1)
    users = factors.where("kind = 0").select(F.col("id").alias("u"), F.concat(bare, F.array(bias, F.lit(1.0))).alias("p"))
    items = factors.where("kind = 1").select(F.col("id").alias("i"), F.concat(bare, F.array(F.lit(1.0), bias)).alias("q"))
    return users, items
