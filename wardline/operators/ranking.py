"""Full-catalogue ranking in blocks: a catalogue of one bounded block comes to the users; of several blocks, each meets each block of users in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.sources.shared import stored, tasks

#: Items of one block, and bytes of their columns: these are sent to every worker, so this bounds what is broadcast.
ITEM_BLOCK, ITEM_BYTES = 1_000_000, 64 << 20
#: Items of one block that are searched by classes.
CLASS_BLOCK = 1 << 22
#: Score cells that a worker holds at once.
CELLS = 1 << 18
RANKED = pa.schema([("u", pa.int64()), ("i", pa.int64()), ("score", pa.float64())])
ABOVE = pa.schema([("u", pa.int64()), ("i", pa.int64()), ("above", pa.int64())])

#: (user columns, item columns) of a block to a users x items matrix.
Score = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


@dataclass(frozen=True)
class Classes:
    """Items whose scores for a user are alike: the search visits a user's classes from the greatest bound down until no other can hold a better item.

    key: the item column that numbers the class. level(users, classes): a users x classes matrix; classes has the item columns of the first item of each
    class. score(level, users, items): the scores of pairs, as flat arrays. bound(level, classes): at least the score of any item of the class.
    falls: whether scores never rise along a class, in the order of the column ``along`` (descending; None: all are equal) and then i; then only a
    class's first k items beside the user's blocked ones can be among the best.
    """

    key: str
    level: Callable[[dict, dict], np.ndarray]
    score: Callable[[np.ndarray, dict, dict], np.ndarray]
    bound: Callable[[np.ndarray, dict], np.ndarray]
    falls: bool = True
    along: str | None = None


#: Pairs that a worker scores at once.
PAIRS = 1 << 20


def classed(items: dict[str, np.ndarray], by: Classes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The items by class, and where each class begins (and the last ends)."""
    order = np.lexsort((items["i"], *([-items[by.along]] if by.along else []), items[by.key]))
    items = {c: x[order] for c, x in items.items()}
    new = np.flatnonzero(np.diff(items[by.key], prepend=items[by.key][0] - 1))
    return items, np.append(new, len(order))


def floors(s: np.ndarray, r: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n rows a value above -inf that its k best scores reach: the least of the best of k stretches of the row. r, the rows, is sorted."""
    least = np.full(n, np.finfo(np.float64).min)
    first = np.searchsorted(r, np.arange(n + 1))
    many = np.diff(first)
    long = np.flatnonzero(many >= 4 * k)
    if len(long):
        cuts = first[long, None] + many[long, None] * np.arange(k + 1) // k  # the last cut is the row's end, its stretch another row's
        best = np.maximum.reduceat(np.append(s, -np.inf), cuts.ravel()).reshape(len(long), k + 1)
        least[long] = np.maximum(least[long], best[:, :k].min(1))
    return least


def reach(near: np.ndarray, many: np.ndarray, begin: np.ndarray, want: np.ndarray, q: int, score) -> tuple[np.ndarray, np.ndarray]:
    """How far into each falling class (rows of near) the want best items of a row may lie, and a score that all of these reach (-inf: there are fewer).

    Every q-th item is scored. One that reaches a score says that those before it in its class do, so the sum of these gives the score that want items
    reach at least; behind the first item below it a class holds none of them.
    """
    n, m = near.shape
    probes = -(-many // q).ravel()
    at = np.repeat(np.arange(n * m), probes)
    j = np.arange(len(at)) - np.repeat(np.cumsum(probes) - probes, probes)
    c, r = near.ravel()[at], at // m
    s = np.asarray(score(r, c, begin[c] + j * q), np.float64)
    order = np.lexsort((-s, r))
    upto = np.cumsum(np.where(j == 0, 1, q)[order])
    first = np.searchsorted(r, np.arange(n))  # r is sorted
    end = np.append(first[1:], len(r))
    base = np.append(0, upto)[first]
    cut = np.searchsorted(upto, base + want)
    least = np.where(cut < end, np.append(s[order], -np.inf)[np.minimum(cut, len(s))], -np.inf)
    inside = np.bincount(at[s >= least[r]], minlength=n * m).reshape(n, m)
    return np.minimum(many, inside * q), least


def best_by_class(batch: pa.RecordBatch, items: dict[str, np.ndarray], starts: np.ndarray, by: Classes, k: int, more: list[str]):
    """What best_of_batch gives, by classes; items and starts as classed() gives them."""
    begin, size = starts[:-1], np.diff(starts)
    classes = {c: x[begin] for c, x in items.items()}
    n = len(size)
    by_id = np.argsort(items["i"], kind="stable")
    ids = items["i"][by_id]
    u, lists = batch["u"].to_numpy(), batch["block"]
    ends, gone = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    own_columns = {"u": u} | {c: as_numpy(batch[c]) for c in more}
    step, q = max(1, CELLS // n), max(1, int(k**0.5))
    for lo in range(0, len(u), step):
        users = {c: x[lo : lo + step] for c, x in own_columns.items()}
        left = np.arange(len(users["u"]))
        blocked = np.diff(ends[lo : lo + len(left) + 1])
        own = gone[ends[lo] : ends[lo + len(left)]]
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        hit = ids[at] == own
        out = np.unique(np.repeat(left, blocked)[hit] * len(ids) + by_id[at[hit]])  # blocked cells
        level = by.level(users, classes)
        bound = by.bound(level, classes)
        m = min(n, 1 + 2 * k // max(1, len(ids) // n))
        while len(left):
            if m < n:
                near = np.argpartition(bound[left], (n - m - 1, n - m), axis=1)
                rest, near = bound[left, near[:, n - m - 1]], near[:, n - m :]
            else:
                rest, near = np.full(len(left), -np.inf), np.broadcast_to(np.arange(n), (len(left), n))
            many = size[near]
            if by.falls:
                many = np.minimum(many, k + blocked[left, None])
            work = (-(-many // q)).sum(1) + k + blocked[left] + m * q if by.falls else many.sum(1)
            total, short, a = np.cumsum(work), [], 0
            while a < len(left):  # pieces of whole users
                z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
                c, count = near[a:z].ravel(), many[a:z].ravel()
                if by.falls:
                    score = lambda r, c, cell, own=left[a:z]: by.score(level[own[r], c], {x: v[own[r]] for x, v in users.items()}, {x: v[cell] for x, v in items.items()})
                    reached, least = reach(near[a:z], many[a:z], begin, k + blocked[left[a:z]], q, score)
                    sure = (rest[a:z] == -np.inf) | (least > rest[a:z])
                    count = np.where(sure[:, None], reached, 0).ravel()
                r = np.repeat(np.repeat(np.arange(z - a), near.shape[1]), count)
                c = np.repeat(c, count)
                cell = begin[c] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                if len(out):
                    code = left[a:z][r] * len(ids) + cell
                    free = out[np.minimum(np.searchsorted(out, code), len(out) - 1)] != code
                    r, c, cell = r[free], c[free], cell[free]
                row = left[a:z][r]
                s = by.score(level[row, c], {x: v[row] for x, v in users.items()}, {x: v[cell] for x, v in items.items()})
                keep = s >= floors(s, r, z - a, k)[r]
                r, cell, s = r[keep], cell[keep], s[keep]
                order = np.lexsort((items["i"][cell], -s, r))
                r, cell, s = r[order], cell[order], s[order]
                first = np.searchsorted(r, np.arange(z - a))
                have = np.diff(np.append(first, len(r)))
                # a user is done where the k-th best is above all that the classes left out may hold
                kth = np.append(s, -np.inf)[np.minimum(first + k - 1, len(s))]
                done = sure if by.falls else (rest[a:z] == -np.inf) | ((have >= k) & (kth > rest[a:z]))
                take = (np.arange(len(r)) - first[r] < k) & done[r]
                yield pa.RecordBatch.from_arrays([pa.array(users["u"][left[a:z][r[take]]]), pa.array(items["i"][cell[take]]), pa.array(s[take].astype(np.float64))], schema=RANKED)
                short.append(left[a:z][~done])
                a = z
            left, m = np.concatenate(short), min(n, 4 * m)


@dataclass(frozen=True)
class Corner:
    """Items of two levels each, whose score is highest where both levels are: the cells of two levels are visited from the greatest bound down, until no
    other can hold a better item.

    levels: how many there are of either kind. modulus: an item's cell tells i modulo it, so cells(users, a, b), the remainders of the items that have these
    levels, finds them. bound(a, b): at least the score of any item of these levels, the same for all users. score(users, items): the scores of pairs, as flat
    arrays.
    """

    levels: tuple[int, int]
    modulus: int
    cells: Callable[[dict, np.ndarray, np.ndarray], np.ndarray]
    bound: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[dict, dict], np.ndarray]


def cornered(items: dict[str, np.ndarray], by: Corner) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The items by remainder, where each remainder's begin, and the cells (as one number) with their bounds, greatest first."""
    left = items["i"] % by.modulus
    order = np.lexsort((items["i"], left))
    starts = np.searchsorted(left[order], np.arange(by.modulus + 1))
    a, b = np.divmod(np.arange(by.levels[0] * by.levels[1]), by.levels[1])
    bound = by.bound(a, b)
    first = np.argsort(-bound, kind="stable")
    return {c: x[order] for c, x in items.items()}, starts, first, bound[first]


def best_by_corner(batch: pa.RecordBatch, items: dict[str, np.ndarray], starts: np.ndarray, cells: np.ndarray, bound: np.ndarray, by: Corner, k: int, more: list[str]):
    """What best_of_batch gives, by cells of two levels; the middle four as cornered() gives them."""
    by_id = np.argsort(items["i"], kind="stable")
    ids = items["i"][by_id]
    u, lists = batch["u"].to_numpy(), batch["block"]
    ends, gone = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    own_columns = {"u": u} | {c: as_numpy(batch[c]) for c in more}
    at = np.minimum(np.searchsorted(ids, gone), len(ids) - 1)
    hit = ids[at] == gone
    blocked = np.diff(ends)
    out = np.unique(np.repeat(np.arange(len(u)), blocked)[hit[ends[0] : ends[-1]]] * len(ids) + by_id[at[ends[0] : ends[-1]][hit[ends[0] : ends[-1]]]])
    left = np.arange(len(u))
    m = -(-8 * k * len(cells) // len(ids))
    while len(left):
        short, whole = [], m >= min(len(ids), len(cells))  # no more cells than items are worth a visit
        rest = -np.inf if whole else bound[m]
        a, b = np.divmod(cells[:m], by.levels[1])
        step = max(1, PAIRS // (len(ids) if whole else max(m, m * len(ids) // by.modulus)))
        for lo in range(0, len(left), step):
            who = left[lo : lo + step]
            users = {c: x[who] for c, x in own_columns.items()}
            if whole:
                begin, count, many = np.zeros(len(who), np.int64), np.full(len(who), len(ids)), 1
            else:
                slot = by.cells({c: x[:, None] for c, x in users.items()}, a[None, :], b[None, :])
                begin, count, many = starts[slot].ravel(), (starts[slot + 1] - starts[slot]).ravel(), m
            r = np.repeat(np.repeat(np.arange(len(who)), many), count)
            cell = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            if len(out):
                code = who[r] * len(ids) + cell
                free = out[np.minimum(np.searchsorted(out, code), len(out) - 1)] != code
                r, cell = r[free], cell[free]
            s = np.asarray(by.score({c: x[r] for c, x in users.items()}, {c: x[cell] for c, x in items.items()}), np.float64)
            order = np.lexsort((items["i"][cell], -s, r))
            r, cell, s = r[order], cell[order], s[order]
            first = np.searchsorted(r, np.arange(len(who)))
            have = np.diff(np.append(first, len(r)))
            kth = np.append(s, -np.inf)[np.minimum(first + k - 1, len(s))]
            done = (rest == -np.inf) | ((have >= k) & (kth > rest))
            take = (np.arange(len(r)) - first[r] < k) & done[r]
            yield pa.RecordBatch.from_arrays([pa.array(users["u"][r[take]]), pa.array(items["i"][cell[take]]), pa.array(s[take])], schema=RANKED)
            short.append(who[~done])
        left, m = np.concatenate(short), 4 * m


def best_of_batch(batch: pa.RecordBatch | pa.Table, items: dict[str, np.ndarray], score: Score, k: int, more: list[str]):
    """The k best items (sorted by i) for each user of a batch (score descending, then item), without the user's ``block`` list."""
    ids = items["i"]
    step = max(1, CELLS // max(1, len(ids)))
    u, lists = batch["u"].to_numpy(), batch["block"]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    gone = lists.values.to_numpy(zero_copy_only=False)
    own_columns = {c: as_numpy(batch[c]) for c in more}
    for lo in range(0, len(u), step):
        hi = min(lo + step, len(u))
        # a score that reads no user may give one row for all of them
        s = np.array(np.broadcast_to(score({"u": u[lo:hi]} | {c: x[lo:hi] for c, x in own_columns.items()}, items), (hi - lo, len(ids))), np.float64)
        own = gone[ends[lo] : ends[hi]]
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        hit = ids[at] == own
        s[row[hit], at[hit]] = -np.inf
        r, c = best_cells(s, min(k, len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(u[lo:hi][r]), pa.array(ids[c]), pa.array(s[r, c])], schema=RANKED)


def as_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column's values; float vectors of one length as a matrix, made once a block and not anew with each step of a search."""
    if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type) and len(column) and not column.null_count:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        for part in [lists] if isinstance(lists, pa.ListArray) else []:
            flat = part.flatten()
            if not flat.null_count and len(np.unique(np.diff(part.offsets.to_numpy()))) == 1:
                return flat.to_numpy().reshape(len(part), -1).astype(np.float64) if len(flat) else np.zeros((len(part), 0))
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def sorted_columns(rows: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    columns = {c: as_numpy(rows[c]) for c in names}
    order = np.argsort(columns["i"], kind="stable")
    return {n: x[order] for n, x in columns.items()}


def search(columns: dict[str, np.ndarray], score: Score | Classes | Corner, k: int, more: list[str]):
    """What gives the best items of a batch of users among a block's, as the score can be searched."""
    if isinstance(score, Classes):
        own = classed(columns, score)
        return lambda batch: best_by_class(batch, *own, score, k, more)
    if isinstance(score, Corner):
        own = cornered(columns, score)
        return lambda batch: best_by_corner(batch, *own, score, k, more)
    return lambda batch: best_of_batch(batch, columns, score, k, more)


def placed(best: pa.RecordBatch, batch: pa.RecordBatch, kept: list[str]) -> pa.RecordBatch:
    """The best items of whole users of a batch in order, with their rank and the users' kept columns."""
    u, i, score = (best[c].to_numpy() for c in ("u", "i", "score"))
    own = batch["u"].to_numpy()
    by_u = np.argsort(own, kind="stable")
    row = by_u[np.searchsorted(own, u, sorter=by_u)]
    order = np.lexsort((i, -score, row))
    row = row[order]
    rank = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
    columns = [best[c].take(pa.array(order)) for c in ("u", "i", "score")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(rank.astype(np.int32)), *[batch[c].take(pa.array(row)) for c in kept]], names=["u", "i", "score", "rank", *kept])


#: What is done with whole users' ranked rows (u, i, score, rank and the item columns) where they are found, and the names and types that it gives.
Then = tuple[Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], str]


def top_of_block(users: DataFrame, items: pa.Table, score: Score | Classes | Corner, k: int, more: list[str], kept: list[str], then: Then | None = None) -> DataFrame:
    """The best items of one block, which is sent to every worker, ranked where they are found: a user's are all found in one task."""
    columns = sorted_columns(items, items.column_names)
    if then:
        of_item, (done, schema) = [c for c in columns if c != "i"], then

        def chosen(batches):
            found = search(columns, score, k, more)
            for batch in batches:
                for best in found(batch) if batch.num_rows else ():
                    rows = placed(best, batch, [])
                    at = np.searchsorted(columns["i"], rows["i"].to_numpy())
                    yield from done(pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(columns[c][at]) for c in of_item]], names=[*rows.schema.names, *of_item]))

        return users.select("u", "block", *more).mapInArrow(chosen, schema)

    def run(batches):
        found = search(columns, score, k, more)
        for batch in batches:
            if batch.num_rows:
                for best in found(batch):
                    yield placed(best, batch, kept)

    types = "".join(f", {c} {users.schema[c].dataType.simpleString()}" for c in kept)
    return users.select("u", "block", *more, *kept).mapInArrow(run, f"u long, i long, score double, rank int{types}")


#: Users of one block, where users and items meet by blocks.
USER_BLOCK = 50_000


def meetings(users: DataFrame, items: DataFrame, blocks: int):
    """Grouped users and items, a block of either in each group, and as many tasks as there are groups (and shuffle partitions).

    A user is sent to each block of items and an item to each block of users. So there are no more blocks of users than keep the tasks busy and a block
    within USER_BLOCK: dealt to a block for each shuffle partition, items would move as often, whatever the number of users.
    """
    at_once = tasks(users.sparkSession)
    users = stored(users)
    dealt = max(1, -(-at_once // blocks), -(-users.count() // USER_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    left = users.withColumn("_ub", part("u", dealt)).withColumn("_ib", each(blocks))
    right = items.withColumn("_ib", part("i", blocks)).withColumn("_ub", each(dealt))
    keys, n = ["_ub", "_ib"], max(at_once, dealt * blocks)
    return left.repartition(n, *keys).groupBy(*keys), right.repartition(n, *keys).groupBy(*keys)


def top_of_blocks(users: DataFrame, items: DataFrame, blocks: int, score: Score | Classes | Corner, k: int, more: list[str]) -> DataFrame:
    """The best items of each of several blocks, dealt by a hash of i: blocks of users and of items meet in tasks of their own, and none pass the driver."""
    names = items.columns

    def run(who: pa.Table, what: pa.Table) -> pa.Table:
        found = []
        if who.num_rows and what.num_rows:
            best = search(sorted_columns(what, names), score, k, more)
            for batch in who.to_batches(max_chunksize=10_000):
                found += best(batch)
        return pa.Table.from_batches(found, RANKED)

    left, right = meetings(users.select("u", "block", *more), items, blocks)
    return left.cogroup(right).applyInArrow(run, "u long, i long, score double")


def best_cells(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n best cells above -inf of each row; ties at the n-th go to the smaller columns."""
    if n == s.shape[1]:
        return np.nonzero(s > -np.inf)
    edge = np.maximum(np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n], np.finfo(s.dtype).min)
    r, c = np.nonzero(s >= edge[:, None])
    tie = s[r, c] == edge[r]
    over = np.bincount(r[~tie], minlength=len(s))
    upto = np.cumsum(tie)
    before = np.append(0, upto)[np.searchsorted(r, np.arange(len(s)))]  # ties in earlier rows
    keep = ~tie | (upto - before[r] <= n - over[r])
    return r[keep], c[keep]


def blocks_of(items: DataFrame, most: int) -> int:
    """How many blocks of at most so many rows and ITEM_BYTES the items make; 0 for none."""
    width = lambda c, t: F.size(c) * 16 if t.startswith("array") else F.lit(8)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(reduce(Column.__add__, [F.coalesce(width(c, t), F.lit(0)) for c, t in items.dtypes])), F.lit(0)).alias("bytes")).first()
    return max(-(-size["n"] // most), -(-size["bytes"] // ITEM_BYTES), 1) if size["n"] else 0


def firsts(items: DataFrame, by: Classes, n: int) -> DataFrame:
    """The first n items of each class, in the order in which its scores fall."""
    w = Window.partitionBy(by.key).orderBy(*([F.desc(by.along)] if by.along else []), "i")
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def rank_catalogue(users: DataFrame, items: DataFrame, score: Score | Classes | Corner, k: int, more: list[str] | None = None, then: Then | None = None) -> DataFrame:
    """u, i, score, rank (1 best) of each user's k best items that are not in the array ``block``, and what further columns the users have.

    users: one row each. items: column i and whatever score reads; more: the user columns that it reads. Under Classes and Corner a user's work is what can be among the best, not the
    catalogue; the result is the same. Items of more than ITEM_BLOCK rows (Classes: CLASS_BLOCK) or ITEM_BYTES are dealt to blocks, whose best are ranked together; blocked items never surface, short lists stay short.
    Of falling classes that make several blocks only the first k items beside the longest ``block`` are searched. then: what becomes of whole users' rows, in place of them.
    """
    # a user row is small and its work is the whole catalogue, so users are dealt by number, not gathered by their bytes
    users = users.repartition(tasks(users.sparkSession), "u")
    kept = [c for c in users.columns if c not in ("u", "i", "score", "rank", "block", *(more or []))]
    items = items.persist()  # measured, then fetched where it is one block
    blocks = blocks_of(items, ITEM_BLOCK if callable(score) else CLASS_BLOCK)
    if blocks > 1 and isinstance(score, Classes) and score.falls:
        longest = users.agg(F.max(F.size("block"))).first()[0] or 0
        whole, items = items, firsts(items, score, k + longest).persist()
        blocks = blocks_of(items, CLASS_BLOCK)
        whole.unpersist()
    if not blocks:
        best = users.sparkSession.createDataFrame([], "u long, i long, score double")
    elif blocks == 1:
        best = top_of_block(users, items.toArrow(), score, k, more or [], kept, then)
        items.unpersist()
        return best
    else:
        best = top_of_blocks(users, items, blocks, score, k, more or [])
    w = Window.partitionBy("u").orderBy(F.desc("score"), "i")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if then:
        of_item, (done, schema) = [c for c in items.columns if c != "i"], then
        names = ["u", "i", "score", "rank", *of_item]

        def whole_user(rows: pa.Table) -> pa.Table:
            rows = rows.select(names).sort_by("rank").combine_chunks()
            return pa.Table.from_batches([x for batch in rows.to_batches() for x in done(batch)])

        return ranked.join(items, "i").select(*names).groupBy("u").applyInArrow(whole_user, schema)
    return ranked.join(users.select("u", *kept), "u") if kept else ranked


def block_lists(users: DataFrame, seen: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """users with ``block``: the distinct seen items of each user, without those of keep (positives stay eligible)."""
    gone = seen.select("u", "i")
    if keep is not None:
        gone = gone.join(keep.select("u", "i"), ["u", "i"], "left_anti")
    lists = gone.groupBy("u").agg(F.collect_set("i").alias("block"))
    return users.join(lists, "u", "left").withColumn("block", F.coalesce("block", F.array().cast("array<bigint>")))


#: Items that a search for places compares with first, for each of the k places.
FIRST = 64


def beaten(users: dict, ids: np.ndarray, own: np.ndarray, ends: np.ndarray, gone: np.ndarray, items: dict[str, np.ndarray], score: Score, k: int) -> np.ndarray:
    """For each row (a user and item ids, of score own) how many items rank above it, counted to k at least.

    Items are met from those of high mean score for these users down, a stretch at a time, each as long as all before it three times; a row that k items
    beat goes no further, so most rows meet few items.
    """
    n, every = len(ids), items["i"]
    some = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
    order = np.argsort(-np.asarray(score({c: x[some] for c, x in users.items()}, items), np.float64).mean(0), kind="stable")
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    # what does not count against a row: the user's blocked items and the row's own
    row = np.append(np.repeat(np.arange(n), np.diff(ends)), np.arange(n))
    out = np.append(gone[ends[0] : ends[-1]], ids)
    at = np.minimum(np.searchsorted(every, out), len(every) - 1)
    hit = every[at] == out
    row, at = row[hit], place[at[hit]]
    above, left, lo, many = np.zeros(n, np.int64), np.arange(n), 0, FIRST * k
    while len(left) and lo < len(every):
        cut = order[lo : lo + many]
        what = {c: x[cut] for c, x in items.items()}
        now = (at >= lo) & (at < lo + many)
        rows, places = row[now], at[now] - lo
        by_row = np.argsort(rows, kind="stable")
        rows, places = rows[by_row], places[by_row]
        step = max(1, CELLS // len(cut))
        for a in range(0, len(left), step):
            who = left[a : a + step]
            s = np.array(score({c: x[who] for c, x in users.items()}, what), np.float64)
            first, last = np.searchsorted(rows, who), np.searchsorted(rows, who, "right")
            size = last - first
            mine = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            s[np.repeat(np.arange(len(who)), size), places[mine]] = -np.inf
            level = own[who, None]
            above[who] += (s > level).sum(1) + ((s == level) & (what["i"][None, :] < ids[who, None])).sum(1)
        left, lo, many = left[above[left] < k], lo + many, 3 * (lo + many)
    return above


def places(wanted: DataFrame, items: DataFrame, score: Score, k: int, more: list[str]) -> DataFrame:
    """u, i, rank of the wanted pairs that are among their user's k best items in the ranking of rank_catalogue.

    wanted: u, i, the user's block (i itself, if there, counts as not blocked) and the columns more. The same ranks as of the whole ranking, but only
    what ranks above a pair is counted, and only to k.
    """
    names = items.columns
    of_item = [c for c in names if c != "i"]
    rows = wanted.select("u", "i", "block", *more).join(items.select("i", F.struct(*of_item).alias("_own")), "i").select("u", "i", "block", *more, *[F.col(f"_own.{c}").alias(f"_own_{c}") for c in of_item])
    blocks = blocks_of(items, ITEM_BLOCK)

    def counted(batch: pa.RecordBatch, columns: dict[str, np.ndarray]):
        lists = batch["block"]
        ends, gone = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        users = {"u": batch["u"].to_numpy()} | {c: as_numpy(batch[c]) for c in more}
        ids = batch["i"].to_numpy()
        mine = {"i": ids} | {c: as_numpy(batch[f"_own_{c}"]) for c in of_item}
        own = np.zeros(len(ids))
        for lo in range(0, len(ids), 64):  # the diagonal: each pair's own score
            cut = slice(lo, lo + 64)
            own[cut] = np.diagonal(score({c: x[cut] for c, x in users.items()}, {c: x[cut] for c, x in mine.items()}))
        above = beaten(users, ids, own, ends, gone, columns, score, k)
        few = above < k
        return pa.RecordBatch.from_arrays([pa.array(users["u"][few]), pa.array(ids[few]), pa.array(above[few])], schema=ABOVE)

    if not blocks:
        return rows.select("u", "i", F.lit(1).alias("rank")).limit(0)
    if blocks == 1:
        columns = sorted_columns(items.toArrow(), names)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield counted(batch, columns)

        found = rows.repartition(tasks(rows.sparkSession), "u").mapInArrow(run, "u long, i long, above long")
    else:

        def meet(who: pa.Table, what: pa.Table) -> pa.Table:
            if not who.num_rows:
                return pa.Table.from_batches([], ABOVE)
            if not what.num_rows:
                return pa.Table.from_arrays([who["u"], who["i"], pa.array(np.zeros(who.num_rows, np.int64))], schema=ABOVE)
            columns = sorted_columns(what, names)
            return pa.Table.from_batches([counted(b, columns) for b in who.to_batches(max_chunksize=10_000)], ABOVE)

        left, right = meetings(rows, items, blocks)
        found = left.cogroup(right).applyInArrow(meet, "u long, i long, above long")
    # a block that k items of beat a pair gives no row for it
    all_ = found.groupBy("u", "i").agg(F.sum("above").alias("above"), F.count("*").alias("n")).where((F.col("n") == blocks) & (F.col("above") < k))
    return all_.select("u", "i", (F.col("above") + 1).cast("int").alias("rank"))
