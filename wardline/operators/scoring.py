"""Scores: factor models, graph propagation, fusion features and gates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.shared import stored, tasks


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gmf(p: Column, q: Column, w: Column, bias: float) -> Column:
    """sigma(sum w p q + bias) over arrays."""
    triple = F.zip_with(F.zip_with(p, q, lambda a, b: a.cast("double") * b.cast("double")), w, lambda x, c: x * c.cast("double"))
    return sigmoid(F.aggregate(triple, F.lit(0.0), lambda s, x: s + x) + bias)


def dot_scorer(digits: int = 9):
    """A block score for rank_catalogue: inner products of users' p and items' q, rounded so that equal vectors tie."""

    def score(rows: dict, columns: dict) -> np.ndarray:
        return np.round(stacked(rows["p"]) @ stacked(columns["q"]).T, digits)

    return score


def stacked(vectors: np.ndarray) -> np.ndarray:
    return (vectors if getattr(vectors, "ndim", 1) == 2 else np.stack(vectors)).astype(np.float64, copy=False)


def gmf_scorer(weights: list[float], bias: float, digits: int = 9):
    """A block score: sigma(sum w p q + bias)."""

    def score(rows: dict, columns: dict) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-((stacked(rows["p"]) * np.array(weights)) @ stacked(columns["q"]).T + bias))), digits)

    return score


def neumf_scorer(factor: list[float], layers: list[tuple[np.ndarray, np.ndarray]], out: list[float], bias: float, digits: int = 9):
    """A block score: factor part and ReLU network over [p, q] under one head."""

    def score(rows: dict, columns: dict) -> np.ndarray:
        u, v = stacked(rows["p"]), stacked(columns["q"])
        h = hidden(u, v, layers)
        return np.round(1 / (1 + np.exp(-((u * np.array(factor)) @ v.T + h @ np.array(out) + bias))), digits)

    return score


def hidden(u: np.ndarray, v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """users x items x units after the ReLU layers over [u, v]; the first one is split, so no pair is concatenated."""
    (w, b), *rest = layers
    h = np.maximum((u @ w[: u.shape[1]])[:, None, :] + (v @ w[u.shape[1] :])[None, :, :] + b, 0)
    for w, b in rest:
        h = np.maximum(h @ w + b, 0)
    return h


def score_rows(users: DataFrame, items: DataFrame, score, more: list[str]) -> DataFrame:
    """u, scores: each user's scores of all items in the order of i, the row of a score matrix. items are one bounded block, like those of rank_catalogue.

    Users are dealt and sorted by u before their rows are made, so that the matrix comes in order and none of it moves; a task holds few rows at a time.
    """
    from wardline.operators.ranking import CELLS, ITEM_BLOCK

    if items.count() > ITEM_BLOCK:
        raise ValueError(f"more than {ITEM_BLOCK} items")
    rows = items.orderBy("i").toArrow()
    columns = {c: rows[c].to_numpy() for c in items.columns}
    step = min(64, max(1, CELLS // max(1, rows.num_rows)))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                s = np.asarray(score({"u": part["u"].to_numpy()} | {c: part[c].to_numpy(zero_copy_only=False) for c in more}, columns), np.float64)
                off = np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]
                yield pa.RecordBatch.from_arrays([part["u"], pa.ListArray.from_arrays(pa.array(off), pa.array(s.ravel()))], names=["u", "scores"])

    dealt = users.select("u", *more).repartitionByRange(tasks(users.sparkSession), "u").sortWithinPartitions("u")
    return dealt.mapInArrow(run, "u long, scores array<double>")


def looked_up(pairs: DataFrame, matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """pairs (u, i) with score, null for an unknown user or item. matrix: u, scores; ids: i and its place in scores.

    A user's pairs meet the user's row of the matrix as one list, so a row of the matrix moves once, not with every pair.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pairs.columns])
    lists = pairs.select("u", "i", row.alias("row")).join(ids.select("i", "place"), "i", "left").groupBy("u").agg(F.collect_list(F.struct("row", "place")).alias("x"))
    cells = F.transform("x", lambda p: F.struct(p["row"].alias("row"), F.get("scores", p["place"].cast("int")).alias("score")))
    return lists.join(matrix, "u", "left").select(F.explode(cells).alias("y")).select("y.row.*", "y.score")


def looked_up_in_rows(pairs: DataFrame, users: DataFrame, items: DataFrame, score, more: list[str]) -> DataFrame:
    """pairs (u, i) with score, null for an unknown user or item: what looked_up finds in score_rows, read where a row is made, so that no row of the matrix moves."""
    from wardline.operators.ranking import ITEM_BLOCK, sorted_columns

    if items.count() > ITEM_BLOCK:
        raise ValueError(f"more than {ITEM_BLOCK} items")
    columns = sorted_columns(items.toArrow(), items.columns)
    lists = pairs.groupBy("u").agg(F.collect_list("i").alias("wanted"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ends, ids = part["wanted"].offsets.to_numpy(), part["wanted"].flatten().to_numpy()
                row, every = np.repeat(np.arange(len(part)), np.diff(ends)), columns["i"]
                out, known = np.full(len(ids), np.nan), np.flatnonzero(part["known"].to_numpy(zero_copy_only=False))
                if len(known) and len(every):
                    some = part.take(pa.array(known))
                    s = np.asarray(score({"u": some["u"].to_numpy()} | {c: some[c].to_numpy(zero_copy_only=False) for c in more}, columns), np.float64)
                    at = np.minimum(np.searchsorted(every, ids), len(every) - 1)
                    place = np.full(len(part), -1)
                    place[known] = np.arange(len(known))
                    hit = (every[at] == ids) & (place[row] >= 0)
                    out[hit] = s[place[row[hit]], at[hit]]
                yield pa.RecordBatch.from_arrays([part["u"].take(pa.array(row)), pa.array(ids), pa.array(out, mask=np.isnan(out))], names=["u", "i", "score"])

    rows = lists.join(users.select("u", *more, F.lit(True).alias("known")), "u", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # few bytes a user, but a row of the matrix each: dealt by number
    return rows.select("u", "wanted", "known", *more).repartition(tasks(pairs.sparkSession), "u").mapInArrow(run, "u long, i long, score double")


def two_class(l0: Column, l1: Column) -> dict[str, Column]:
    """p0, p1, margin and pred of two logits; the exponent is never positive, so nothing overflows. Ties are 0."""
    e = F.exp(-F.abs(l1 - l0))
    high, low = 1 / (1 + e), e / (1 + e)
    p1 = F.when(l1 >= l0, high).otherwise(low)
    p0 = F.when(l1 >= l0, low).otherwise(high)
    return {"p0": p0, "p1": p1, "margin": p1 - p0, "pred": (l1 > l0).cast("int")}


def with_predictions(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """pairs with psg_pred, p1, margin: of the pair's last prediction (largest n), 0 where there is none."""
    last = predictions.groupBy("u", "i").agg(F.max(F.struct("n", "psg_pred", "p1", "margin")).alias("x"))
    rows = pairs.join(last, ["u", "i"], "left")
    return rows.withColumns({c: F.coalesce(F.col(f"x.{c}").cast(t), F.lit(0).cast(t)) for c, t in (("psg_pred", "double"), ("p1", "double"), ("margin", "double"))}).drop("x")


def bucket_features() -> dict[str, Column]:
    """The eleven gate inputs of rating-bucket data, from base, aug, psg_pred, p1, margin, the bucket flags and is_minor."""
    b, p = F.col("base"), F.col("aug")
    flags = {f: F.col(f).cast("double") for f in ("r17", "rplus", "rx", "unsafe_any")}
    return {"base": b, "aug": p, "gap": p - b, "pred": F.col("psg_pred").cast("double"), "p1": F.col("p1"), "margin": F.col("margin")} | flags | {"minor": F.col("is_minor").cast("double")}


def single_head(features: dict[str, Column], weights: list[list[float]], bias: list[float], out: list[float], out_bias: float, most: float) -> Column:
    """most * sigma of a one-layer ReLU network over the features."""
    h = relu_layer(F.array(*features.values()), weights, bias)
    return most * sigmoid(dot(h, F.array(*[F.lit(float(w)) for w in out])) + out_bias)


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    """An array at mean 0 and population variance 1."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + epsilon))


def bucket_heads(features: dict[str, Column], shared: Column, heads: dict[str, tuple[list[float], float]], most: float, by_p1: float = 1.0, by_margin: float = 0.1, by_unsafe: float = 0.8) -> Column:
    """most times three heads over shared units: preference; confidence, moved by p1 - 0.5 and margin; safety, lowered by softplus(by_unsafe) where unsafe."""
    level = {k: dot(shared, F.array(*[F.lit(float(w)) for w in ws])) + b for k, (ws, b) in heads.items()}
    p1 = F.least(F.greatest(features["p1"], F.lit(0.0)), F.lit(1.0))
    level["confidence"] = level["confidence"] + by_p1 * (p1 - 0.5) + by_margin * features["margin"]
    level["safety"] = level["safety"] - softplus(F.lit(by_unsafe)) * features["unsafe_any"]
    return reduce(Column.__mul__, [sigmoid(x) for x in level.values()], F.lit(most))


def gate_step(rows: DataFrame, names: list[str], weights: list[float], rate: float, margin: float = 0.1) -> tuple[list[float], float]:
    """One full-batch gradient step of a linear gate over a hinge loss of safe against unsafe rows, and the loss before it.

    rows: base, aug, target (1 safe and liked, -1 not) and the named features.
    The fused score is base + sigma(w x) (aug - base); the loss of a row is
    max(0, margin - target * score). Only sums leave the tasks.
    """
    z = reduce(Column.__add__, [F.col(n) * float(w) for n, w in zip(names, weights, strict=True)])
    g = sigmoid(z)
    short = margin - F.col("target") * (F.col("base") + g * (F.col("aug") - F.col("base")))
    slope = F.when(short > 0, -F.col("target") * (F.col("aug") - F.col("base")) * g * (1 - g)).otherwise(0.0)
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.greatest(short, F.lit(0.0))).alias("loss"), *[F.sum(slope * F.col(n)).alias(f"_{j}") for j, n in enumerate(names)]).first()
    n = max(1, sums["n"])
    return [w - rate * (sums[f"_{j}"] or 0.0) / n for j, w in enumerate(weights)], (sums["loss"] or 0.0) / n


def train_gate(rows: DataFrame, names: list[str], steps: int, rate: float) -> tuple[list[float], list[float]]:
    """Weights and losses of gate_step from zero."""
    weights, losses = [0.0] * len(names), []
    for _ in range(steps):
        weights, loss = gate_step(rows, names, weights, rate)
        losses.append(loss)
    return weights, losses


def learned_safety(rows: DataFrame, label: str, buckets: int = 1 << 18):
    """A fitted logistic model of a pair being safe from its ids alone: user, item, whether the user is a minor, and item by minor.

    Each id is one hashed indicator, so the model's size is bounded by buckets,
    whatever the number of users and items. rows: u, i, is_minor, label;
    transform() needs the first three and adds probability.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher, SQLTransformer

    ids = SQLTransformer(statement="select *, cast(u as string) _u, cast(i as string) _i, cast(is_minor as string) _m, concat_ws(':', i, is_minor) _im from __THIS__")
    hashed = FeatureHasher(inputCols=["_u", "_i", "_m", "_im"], outputCol="_x", numFeatures=buckets)
    return Pipeline(stages=[ids, hashed, LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.001, maxIter=50)]).fit(rows)


def hop_means(edges: DataFrame, nodes: DataFrame, names: list[str], hops: int) -> DataFrame:
    """node and the named columns: means over hops 0..hops of the symmetrically normalised neighbour sums; a node without a value (null) in any layer has none.

    The weight of an edge is one factor of each end, so nodes are scaled before and after a hop and edges carry no weights. An edge carries all columns in
    one row, each layer is computed once, and sums are partial before their shuffle; the edges of a node with very many are split by the engine's skew join.
    """
    edges = stored(edges.select("a", "b"))
    degree = stored(edges.groupBy(F.col("a").alias("node")).agg((1 / F.sqrt(F.count("*").cast("double"))).alias("s")))
    scaled = lambda rows, key: rows.join(degree, "node").select(F.col("node").alias(key), *[(F.col(n) * F.col("s")).alias(n) for n in names])
    layers = [stored(nodes.select("node", *[F.col(n).cast("double").alias(n) for n in names]))]
    for _ in range(hops):
        moved = edges.join(scaled(layers[-1], "b"), "b").groupBy(F.col("a").alias("node")).agg(*[F.sum(n).alias(n) for n in names])
        layers.append(stored(scaled(moved, "node")))
    total = reduce(DataFrame.unionByName, layers).groupBy("node")
    return total.agg(*[(F.sum(n) / (hops + 1)).alias(n) for n in names])


#: Dimensions that an edge carries at once.
DIMS_AT_ONCE = 64


def propagate(edges: DataFrame, nodes: DataFrame, hops: int = 1, digits: int | None = None) -> DataFrame:
    """node, dim, x: hop_means of nodes (node, dim, x). edges: (a, b) once per direction."""
    nodes = stored(nodes.select("node", "dim", "x"))
    dims = sorted(r["dim"] for r in nodes.select("dim").distinct().collect())
    out = []
    for lo in range(0, len(dims), DIMS_AT_ONCE):
        part = dims[lo : lo + DIMS_AT_ONCE]
        names = [f"x{j}" for j in range(len(part))]
        wide = nodes.groupBy("node").agg(*[F.sum(F.when(F.col("dim") == d, F.col("x"))).alias(n) for n, d in zip(names, part, strict=True)])
        cells = F.array(*[F.struct(F.lit(d).cast(nodes.schema["dim"].dataType).alias("dim"), F.col(n).alias("x")) for n, d in zip(names, part, strict=True)])
        out.append(hop_means(edges, wide, names, hops).select("node", F.explode(cells).alias("c")).select("node", "c.dim", "c.x").where("x is not null"))
    found = reduce(DataFrame.unionByName, out) if out else nodes.select("node", "dim", F.col("x").cast("double").alias("x"))
    return found if digits is None else found.withColumn("x", F.round("x", digits))


def propagate_vectors(edges: DataFrame, nodes: DataFrame, hops: int = 1) -> DataFrame:
    """node, x: hop_means of vectors: nodes (node, x: array of one length)."""
    nodes = stored(nodes.select("node", "x"))
    names = [f"x{j}" for j in range(nodes.agg(F.max(F.size("x"))).first()[0] or 0)]
    wide = nodes.select("node", *[F.col("x")[j].alias(n) for j, n in enumerate(names)])
    return hop_means(edges, wide, names, hops).select("node", F.array(*names).cast("array<double>").alias("x"))


def fused(base: Column, other: Column, gate: Column) -> Column:
    return base + gate * (other - base)


def gate_features() -> dict[str, Column]:
    """Inputs of the fusion gate from columns base, aug, psg_pred, p1, margin, is_minor and the risk flags."""
    b, p = F.col("base"), F.col("aug")
    flags = ("sex", "violence", "profanity", "drug", "intense", "adult_hard", "unsafe_any")
    return {"base": b, "aug": p, "gap": p - b, "abs_gap": F.abs(p - b), "pred": F.col("psg_pred").cast("double"), "p1": F.col("p1"), "margin": F.col("margin"), "minor": F.col("is_minor").cast("double")} | {f: F.col(f).cast("double") for f in flags[-6:]}


def head(features: list[Column], weights: list[float], bias: float) -> Column:
    total = F.lit(bias)
    for x, w in zip(features, weights, strict=True):
        total = total + x * w
    return sigmoid(total)


def three_heads(features: dict[str, Column], weights: dict[str, tuple[list[float], float]], most: float) -> Column:
    """most * sigma(relevance head) * sigma(safety head) * sigma(trust head) over given weights."""
    out = F.lit(most)
    for w, b in weights.values():
        out = out * head(list(features.values()), w, b)
    return out


def dot(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def relu_layer(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """max(0, W x + b) over an array; weights: one row per unit."""
    units = [F.greatest(dot(x, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b)), F.lit(0.0)) for row, b in zip(weights, bias, strict=True)]
    return F.array(*units)


def neumf(p: Column, q: Column, factor: list[float], hidden: Column, out: list[float], bias: float) -> Column:
    """sigma(factor . (p q) + out . hidden + bias): factor and network parts under one head."""
    product = F.zip_with(p, q, lambda a, b: a.cast("double") * b.cast("double"))
    return sigmoid(dot(product, F.array(*[F.lit(float(w)) for w in factor])) + dot(hidden, F.array(*[F.lit(float(w)) for w in out])) + bias)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def losses(positive: Column, negative: Column, margin: float = 0.1) -> dict[str, Column]:
    """Per-pair training losses of two raw scores: pairwise logistic, binary cross-entropy of both, hinge."""
    return {"bpr": softplus(negative - positive), "bce": (softplus(-positive) + softplus(negative)) / 2, "hinge": F.greatest(margin - (positive - negative), F.lit(0.0))}
