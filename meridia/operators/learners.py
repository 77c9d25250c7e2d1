"""Learners that ``pyspark.ml`` lacks, as estimators over ``features, label``.

Each fit stages the training rows once and then makes passes over them: a task
sums what a pass needs (histograms, ranges, counts, weights) for the few open
nodes or classes, Spark adds the sums up by key, and only these, whose size
follows from the model and not from the rows, come to the driver.  Rows are
ordered by a hash of their own values, so partitioning never changes a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as mc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch_path
from .forests import TreeTable, matrix

#: Rows of one ordered block of an online pass.
SHARD = 20_000
#: Rows that are mapped to kernel features at a time: each takes several arrays of as many numbers as landmarks.
KERNEL_ROWS = 1000
#: Bytes of summed arrays that one Arrow batch holds.
PACK = 1 << 20


def entries(features: str) -> Column:
    """A vector column as an array; null for null."""
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


def staged_rows(df: DataFrame, features: str, label: str, weight: str | None) -> tuple[DataFrame, str, list[float]]:
    """``x, y, w`` of the rows with a full vector and a label, written once; its path, and the labels in order.

    ``y`` is the label's place.  Labels are few: they name the classes.
    """
    path = scratch_path(df.sparkSession, "train")
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.select(entries(features).alias("x"), F.col(label).cast("double").alias("label"), w.alias("w"))
    rows.where("x is not null and label is not null and not exists(x, v -> v is null or isnan(v))").write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    classes = sorted(r["label"] for r in held.select("label").distinct().collect())
    if not classes:
        raise ValueError("no row to learn from")
    return held.select("x", (F.array_position(F.lit(classes), F.col("label")) - 1).cast("int").alias("y"), "w"), path, classes


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def packed(cells: Iterator[tuple[int, np.ndarray]], fields: Callable[[list[int]], list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Keys and their arrays as Arrow batches of about ``PACK`` bytes, so that many small arrays share a batch."""
    keys, held, size = [], [], 0
    for key, found in cells:
        keys.append(key)
        held.append(np.ascontiguousarray(found, dtype=float).tobytes())
        size += len(held[-1]) + 8
        if size >= PACK:
            yield pa.RecordBatch.from_arrays([*fields(keys), pa.array(held, pa.binary())], names=names)
            keys, held, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([*fields(keys), pa.array(held, pa.binary())], names=names)


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], finish: Callable[[int, np.ndarray], np.ndarray] | None = None, join=np.add) -> dict[int, np.ndarray]:
    """A pass: what the tasks make of their batches, joined by key (added, unless told otherwise) and finished there.

    Partial arrays of a key are joined in the order of their partitions.  The
    tasks that join are as many as the arrays' bytes call for, so that a pass
    over few keys is not mostly the start of empty tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = work(b for b in batches if b.num_rows)
        part = TaskContext.get().partitionId()
        yield from packed(found.items(), lambda keys: [pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32())], ["key", "part", "cells"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        now, held = None, None
        for batch in batches:
            for key, cells in zip(batch.column(0).to_pylist(), batch.column(2)):
                own = np.frombuffer(cells.as_buffer(), float)
                if key != now:
                    if held is not None:
                        yield now, held if finish is None else finish(now, held)
                    now, held = key, own
                else:
                    held = join(held, own)
        if held is not None:
            yield now, held if finish is None else finish(now, held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(joined(batches), lambda keys: [pa.array(keys, pa.int64())], ["key", "cells"])

    sums = rows.mapInArrow(partial, "key long, part int, cells binary").repartition("key").sortWithinPartitions("key", "part")
    return {r["key"]: np.frombuffer(r["cells"], float) for r in sums.mapInArrow(merge, "key long, cells binary").collect()}


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Cut points of each feature, at most ``bins - 1``: quantiles of its values, none at the largest."""
    points = [i / bins for i in range(1, bins)]
    found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", F.lit(points), F.lit(max(10_000, 20 * bins))).alias("q"), F.max("v").alias("most")).collect()
    return [np.array(sorted(set(r["q"]) - {r["most"]})) for r in sorted(found, key=lambda r: r["i"])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin ``b`` of a feature holds what is above cut ``b - 1`` and at most cut ``b``."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if edges else np.zeros((len(x), 0), int)


@dataclass
class Growing:
    """A tree while it grows: rows with ``x <= threshold`` go left, and a node of feature -1 is a leaf so far."""

    outputs: int
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    value: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.value = self.value or [np.zeros(self.outputs)]

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.threshold[node] = feature, threshold
        self.left[node], self.right[node] = children
        for _ in children:
            for held, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.cover, 0.0)):
                held.append(empty)
            self.value.append(np.zeros(self.outputs))
        return children

    def table(self) -> TreeTable:
        return TreeTable(*[np.array(c) for c in (self.feature, self.threshold, self.left, self.right, self.cover)], np.stack(self.value))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


# Boosting


@dataclass
class Boosted:
    """Additive trees a class (one for two classes); ``trees`` holds a list of class trees for each round."""

    classes: list[float]
    base: np.ndarray
    trees: list[list[TreeTable]] = field(default_factory=list)

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.tile(self.base if not first else np.zeros_like(self.base), (len(x), 1))
        for round_ in self.trees[first:]:
            for k, tree in enumerate(round_):
                out[:, k] += tree.predict(x)[:, 0]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.margins(x)
        return softmax(np.hstack([np.zeros((len(z), 1)), z]) if z.shape[1] == 1 else z)


def best_split(cells: np.ndarray, features: int, bins: int, ridge: float, least: float) -> np.ndarray:
    """``gain, feature, bin, G and H left, G, H`` of the best split of a node's packed histogram (first of equals)."""
    sums = cells.reshape(features, bins, 2).cumsum(1)
    g, h = sums[0, -1]
    gl, hl = sums[:, :-1, 0], sums[:, :-1, 1]
    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
    gain = np.where((hl >= least) & (h - hl >= least), gain, 0.0)
    at = int(gain.argmax()) if gain.size else 0
    f, b = divmod(at, max(1, bins - 1))
    return np.array([gain.flat[at] if gain.size else 0.0, f, b, gl.flat[at] if gain.size else 0.0, hl.flat[at] if gain.size else 0.0, g, h])


def fit_boosted(rows: DataFrame, classes: list[float], rounds: int, depth: int, most_leaves: int, bins: int, rate: float, ridge: float = 1.0, least: float = 1.0, restage: int = 10) -> Boosted:
    """Softmax boosting on shared binned histograms.

    A pass sums gradients and curvatures of every open node of all the round's
    class trees; a node's histogram goes to one task, which answers with its
    best split.  Open nodes are split in order of gain until a tree has
    ``most_leaves``: few leaves and much depth grow a tree leaf by leaf, many
    leaves level by level.  Margins of finished rounds are written every
    ``restage`` rounds, so a pass walks few trees.
    """
    k = len(classes)
    counts = summed(rows, lambda batches: {0: sum(np.bincount(y, w, k) for _, y, w in map(arrays, batches)) + np.zeros(k)})[0]
    share = counts / counts.sum()
    outputs = 1 if k == 2 else k
    with np.errstate(divide="ignore"):
        base = np.log(share) if outputs > 1 else np.array([math.log(share[1] / share[0])]) if k == 2 else np.zeros(1)
    model = Boosted(classes, base)
    if k < 2:
        model.base = np.zeros(1)
        return model
    edges = bin_edges(rows, bins)
    d, width = len(edges), max((len(e) for e in edges), default=0) + 1
    held, path, first = rows.withColumn("m", F.lit(base.tolist())), None, 0

    for round_ in range(rounds):
        growing = [Growing(1) for _ in range(outputs)]
        open_ = {c: [0] for c in range(outputs)}
        for level in range(depth + 1):
            shared = rows.sparkSession.sparkContext.broadcast((model, first, [t.table() for t in growing], {c: set(n) for c, n in open_.items()}))

            def work(batches: Iterator[pa.RecordBatch], shared=shared) -> dict[int, np.ndarray]:
                model, first, growing, open_ = shared.value
                out: dict[int, np.ndarray] = {}
                for batch in batches:
                    x, y, w = arrays(batch)
                    z = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) + Boosted(model.classes, np.zeros(outputs), model.trees[first:]).margins(x)
                    p = 1 / (1 + np.exp(-z)) if outputs == 1 else softmax(z)
                    hit = (y[:, None] == np.arange(k)[None, 1 if outputs == 1 else 0 :]).astype(float)
                    g, h = (p - hit) * w[:, None], np.maximum(p * (1 - p), 1e-16) * w[:, None]
                    bin_ = binned(x, edges)
                    spots = bin_ + np.arange(d) * width
                    for c, tree in enumerate(growing):
                        leaf = tree.leaf_of(x)
                        for node in open_[c] & set(np.unique(leaf).tolist()):
                            at = np.flatnonzero(leaf == node)
                            where = spots[at].ravel()
                            cells = np.stack([np.bincount(where, np.repeat(v[at, c], d), d * width) for v in (g, h)], 1).ravel()
                            key = node * outputs + c
                            out[key] = out[key] + cells if key in out else cells
                return out

            found = summed(held, work, lambda key, cells: best_split(cells, d, width, ridge, least))
            shared.unpersist()
            nodes = {c: [] for c in range(outputs)}
            for key, (gain, f, b, gl, hl, g, h) in found.items():
                node, c = divmod(key, outputs)
                growing[c].value[node], growing[c].cover[node] = np.array([-rate * g / (h + ridge)]), h
                nodes[c].append((-gain, node, int(f), int(b), gl, hl, g, h))
            open_ = {c: [] for c in range(outputs)}
            for c, tree in enumerate(growing):
                leaves = tree.feature.count(-1)
                for gain, node, f, b, gl, hl, g, h in sorted(nodes[c]):
                    if level < depth and gain < -1e-9 and leaves < most_leaves and b < len(edges[f]):
                        children = tree.split(node, f, float(edges[f][b]))
                        for child, (a, s) in zip(children, ((gl, hl), (g - gl, h - hl))):
                            tree.value[child], tree.cover[child] = np.array([-rate * a / (s + ridge)]), s
                        # A child too light to be split again needs no histogram.
                        open_[c] += [n for n, s in zip(children, (hl, h - hl)) if level + 1 < depth and s >= 2 * least]
                        leaves += 1
            if not any(open_.values()):
                break
        model.trees.append([t.table() for t in growing])
        if len(model.trees) - first >= restage and round_ < rounds - 1:
            shared = rows.sparkSession.sparkContext.broadcast(Boosted(classes, np.zeros(outputs), model.trees[first:]))

            def moved(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        x, _, _ = arrays(batch)
                        z = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) + shared.value.margins(x)
                        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(z))], names=["x", "y", "w", "m"])

            new = scratch_path(rows.sparkSession, "margins")
            held.mapInArrow(moved, held.schema).write.parquet(new)
            held, first = rows.sparkSession.read.schema(held.schema).parquet(new), len(model.trees)
            if path:
                remove(rows.sparkSession, path)
            path = new
    if path:
        remove(rows.sparkSession, path)
    return model


# Extremely randomised trees


@dataclass
class Voting:
    """Trees whose leaves hold class shares; a forest's probabilities are their mean."""

    classes: list[float]
    trees: list[TreeTable]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)


def fit_random_cuts(rows: DataFrame, classes: list[float], n_features: int, trees: int, depth: int, seed: int, least: float = 2.0) -> Voting:
    """Trees with one random cut a feature: all rows, no bootstrap.

    Level by level, a pass finds the range of each open node's features and a
    second one counts classes left of a cut drawn uniformly from each range;
    the cut with the least Gini impurity is taken.  A node's features and cuts
    follow from seed, tree and node alone.
    """
    k, some = len(classes), max(1, int(math.sqrt(n_features)))
    growing = [Growing(k) for _ in range(trees)]
    total = summed(rows, lambda batches: {0: sum((np.bincount(y, w, k) for _, y, w in map(arrays, batches)), np.zeros(k))})[0]
    counts = [{0: total} for _ in range(trees)]
    open_ = [[0] if (total > 0).sum() > 1 else [] for _ in range(trees)]

    def features_of(tree: int, node: int) -> tuple[np.ndarray, np.random.Generator]:
        rng = np.random.default_rng([seed, tree, node])
        return rng.permutation(n_features)[:some], rng

    def per_node(batches: Iterator[pa.RecordBatch], shared, reduce) -> dict[int, np.ndarray]:
        tables, chosen = shared.value
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, w = arrays(batch)
            for t, tree in enumerate(tables):
                leaf = tree.leaf_of(x)
                order = np.argsort(leaf, kind="stable")
                names, opens = np.unique(leaf[order], return_index=True)
                for node, lo, hi in zip(names.tolist(), opens.tolist(), [*opens[1:].tolist(), len(order)]):
                    if (t, node) in chosen:
                        at = order[lo:hi]
                        cells = reduce(x[at], y[at], w[at], chosen[t, node])
                        key = node * trees + t
                        out[key] = join(out[key], cells) if key in out else cells
        return out

    for level in range(depth):
        names = [(t, node) for t in range(trees) for node in open_[t]]
        if not names:
            break
        join = np.maximum
        chosen = {(t, node): features_of(t, node)[0] for t, node in names}
        shared = rows.sparkSession.sparkContext.broadcast(([g.table() for g in growing], chosen))
        ranges = summed(rows, lambda batches, s=shared: per_node(batches, s, lambda x, y, w, f: np.concatenate([x[:, f].max(0), (-x[:, f]).max(0)])), join=np.maximum)
        shared.unpersist()
        cuts = {}
        for key, cells in ranges.items():
            node, t = divmod(key, trees)
            f, rng = features_of(t, node)
            hi, lo = cells[:some], -cells[some:]
            cuts[t, node] = f, lo + rng.random(some) * (hi - lo), hi > lo
        join = np.add
        shared = rows.sparkSession.sparkContext.broadcast(([g.table() for g in growing], {n: c[:2] for n, c in cuts.items()}))

        def left_counts(x, y, w, cut):
            under = x[:, cut[0]] <= cut[1]
            return np.stack([(under * (w * (y == c))[:, None]).sum(0) for c in range(k)], 1).ravel()

        lefts = summed(rows, lambda batches, s=shared: per_node(batches, s, left_counts))
        shared.unpersist()
        open_ = [[] for _ in range(trees)]
        for key in sorted(lefts):
            node, t = divmod(key, trees)
            left = lefts[key].reshape(some, k)
            own = counts[t][node]
            right = own - left
            nl, nr = left.sum(1), right.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gini = own.sum() - (left**2).sum(1) / nl - (right**2).sum(1) / nr
            usable = cuts[t, node][2] & (nl > 0) & (nr > 0)
            if not usable.any():
                continue
            best = int(np.where(usable, gini, np.inf).argmin())
            for child, c in zip(growing[t].split(node, int(cuts[t, node][0][best]), float(cuts[t, node][1][best])), (left[best], right[best])):
                counts[t][child] = c
                if level + 1 < depth and (c > 0).sum() > 1 and c.sum() >= least:
                    open_[t].append(child)
    for t, tree in enumerate(growing):
        for node, c in counts[t].items():
            tree.value[node], tree.cover[node] = c / c.sum(), c.sum()
    return Voting(classes, [g.table() for g in growing])


# AdaBoost


@dataclass
class Stumps:
    """SAMME: ``feature, threshold, class left, class right, vote`` of each stump."""

    classes: list[float]
    stumps: list[tuple[int, float, int, int, float]] = field(default_factory=list)

    def guesses(self, x: np.ndarray, stump: tuple) -> np.ndarray:
        f, t, left, right, _ = stump
        return np.where(x[:, f] <= t, left, right)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), len(self.classes)))
        for s in self.stumps:
            votes[np.arange(len(x)), self.guesses(x, s)] += s[4]
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        # A class's decision is its vote less the mean of the others', softmaxed over classes.
        total = max(sum(s[4] for s in self.stumps), 1e-300)
        k = len(self.classes)
        return softmax((votes * k / (k - 1) - votes.sum(1, keepdims=True) / (k - 1)) / total / max(1, k - 1))


def fit_stumps(rows: DataFrame, classes: list[float], rounds: int, bins: int = 255) -> Stumps:
    """AdaBoost (SAMME) on stumps: a pass a round sums weights by class and bin; weights follow from the stumps so far."""
    k = len(classes)
    model = Stumps(classes)
    edges = bin_edges(rows, bins)
    d, width = len(edges), max((len(e) for e in edges), default=0) + 1
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> dict[int, np.ndarray]:
            model, total = shared.value, np.zeros(d * width * k)
            for batch in batches:
                x, y, w = arrays(batch)
                for s in model.stumps:
                    w = w * np.exp(s[4] * (model.guesses(x, s) != y))
                total += np.bincount(((binned(x, edges) + np.arange(d) * width) * k + y[:, None]).ravel(), np.repeat(w, d), d * width * k)
            return {0: total}

        sums = summed(rows, work)[0].reshape(d, width, k)
        shared.unpersist()
        own = sums[0].sum(0)
        left = sums.cumsum(1)[:, :-1]
        right = own - left
        nl, nr = left.sum(2), right.sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gini = own.sum() - np.where(nl > 0, (left**2).sum(2) / nl, 0) - np.where(nr > 0, (right**2).sum(2) / nr, 0)
        for f, e in enumerate(edges):
            gini[f, len(e) :] = np.inf
        if not gini.size or not np.isfinite(gini.min()):
            break
        f, b = np.unravel_index(int(gini.argmin()), gini.shape)
        a, c = int(left[f, b].argmax()), int(right[f, b].argmax())
        error = 1 - (left[f, b, a] + right[f, b, c]) / own.sum()
        if error >= 1 - 1 / k:
            break
        vote = math.log((1 - max(error, 1e-12)) / max(error, 1e-12)) + math.log(k - 1) if k > 1 else 1.0
        model.stumps.append((int(f), float(edges[f][b]), a, c, vote))
        if error <= 1e-12:
            break
    return model


# Online learners


@dataclass
class Linear:
    """A weight vector a class, the intercept last."""

    classes: list[float]
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:, :-1].T + self.weights[:, -1]
        return softmax(np.hstack([-z, z]) if len(z.T) == 1 else z)


def _online_pass(weights: np.ndarray, x: np.ndarray, sign: np.ndarray, rule: str, limit: float) -> np.ndarray:
    """One pass over a block, row by row, every class against the rest; returns the mean of the weights along it."""
    w, mean = weights.copy(), np.zeros_like(weights)
    size = (x * x).sum(1)
    for row, s, n in zip(x, sign, size):
        margin = s * (w @ row)
        if rule == "perceptron":
            step = (margin <= 0) * s
        else:
            step = np.minimum(limit, np.maximum(0.0, 1 - margin) / max(n, 1e-12)) * s
        w += step[:, None] * row
        mean += w
    return mean / max(1, len(x))


def fit_online(rows: DataFrame, classes: list[float], rule: str, epochs: int, limit: float = 1.0, shard: int = SHARD) -> Linear:
    """Perceptron or passive-aggressive (first kind) passes, weights averaged over rows and blocks after each epoch.

    Rows are dealt into blocks of about ``shard`` by a hash of their values and
    ordered by it within, so neither reruns nor partitioning change anything.
    A block is packed into one row once; an epoch runs all of them at once from
    the same weights.
    """
    spark = rows.sparkSession
    n = rows.count()
    blocks = max(1, -(-n // shard))
    k = len(classes)
    key = F.xxhash64("x", "y")
    dealt = rows.withColumn("h", key).withColumn("block", F.pmod(F.xxhash64("h", F.lit(17)), F.lit(blocks)))
    dealt = dealt.repartition(min(blocks, 100_000), "block").sortWithinPartitions("block", "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, xs, ys = None, [], []

        def out() -> pa.RecordBatch:
            x, y = np.concatenate(xs), np.concatenate(ys)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in ((now, pa.int64()), (x.tobytes(), pa.binary()), (y.astype("<i4").tobytes(), pa.binary()))], names=["block", "x", "y"])

        for batch in batches:
            x, y, _ = arrays(batch)
            block = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if block[lo] != now and xs:
                        yield out()
                        xs, ys = [], []
                    now = int(block[lo])
                    xs.append(x[lo:hi])
                    ys.append(y[lo:hi])
        if xs:
            yield out()

    path = scratch_path(spark, "blocks")
    dealt.select("x", "y", "w", "block").mapInArrow(pack, "block long, x binary, y binary").write.parquet(path)
    packed = spark.read.schema("block long, x binary, y binary").parquet(path)
    dim = rows.select(F.size("x").alias("d")).first()["d"]
    outputs = 1 if k == 2 else k
    weights = np.zeros((outputs, dim + 1))
    for _ in range(epochs if k > 1 else 0):
        shared = spark.sparkContext.broadcast(weights)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> dict[int, np.ndarray]:
            out = {}
            for batch in batches:
                for block, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                    x, y = np.frombuffer(x).reshape(-1, dim), np.frombuffer(y, "<i4")
                    sign = np.where(y[:, None] == np.arange(k)[None, 1 if outputs == 1 else 0 :], 1.0, -1.0)
                    mean = _online_pass(shared.value, np.hstack([x, np.ones((len(x), 1))]), sign, rule, limit)
                    out[block] = np.append(mean.ravel() * len(x), len(x))
            return out

        # One mean a block, added up in the order of blocks.
        means = spark_sum_by_block(packed, work)
        weights = (means[:-1] / means[-1]).reshape(weights.shape)
        shared.unpersist()
    remove(spark, path)
    return Linear(classes, weights)


def spark_sum_by_block(packed: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> np.ndarray:
    """The sum of the blocks' arrays: by groups of 256 blocks in tasks, each in the order of blocks, then over the groups."""

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cells in work([batch]).items():
                yield pa.RecordBatch.from_arrays([pa.array([block // 256]), pa.array([block]), pa.array([cells.tobytes()], pa.binary())], names=["part", "block", "cells"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("cells").to_pylist()))
        total = sum(np.frombuffer(c) for _, c in rows)
        return pa.table({"part": table.column("part").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    made = packed.mapInArrow(means, "part long, block long, cells binary").groupBy("part").applyInArrow(add, "part long, cells binary").collect()
    return sum(np.frombuffer(r["cells"]) for r in sorted(made, key=lambda r: r["part"]))


# Kernel machine


@dataclass
class Nystrom:
    """Landmarks of a radial kernel and the root of their inverse kernel matrix."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float
    #: Root mean square of (approximate - exact) kernel values between the landmarks' successors in hash order.
    error: float = 0.0

    def kernel(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
        return np.exp(-self.gamma * np.maximum(square, 0.0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.landmarks) @ self.root


def fit_nystrom(rows: DataFrame, landmarks: int = 256, seed: int = 42) -> Nystrom:
    """A radial kernel map from ``landmarks`` distinct rows, those of smallest hash; the next as many measure its error.

    ``gamma`` is one over the number of features times the variance of all entries.
    """
    moments = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("var")).first()
    d = rows.select(F.size("x").alias("d")).first()["d"]
    gamma = 1.0 / (d * moments["var"]) if moments["var"] else 1.0
    picked = rows.select("x").distinct().orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(2 * landmarks).collect()  # a documented sample
    x = np.array([r["x"] for r in picked], float)
    model = Nystrom(x[:landmarks], np.eye(1), gamma)
    values, axes = np.linalg.eigh(model.kernel(model.landmarks, model.landmarks))
    kept = values > 1e-10 * values.max()
    model.root = axes[:, kept] / np.sqrt(values[kept])
    if len(rest := x[landmarks:]):
        near = model.features(rest)
        model.error = float(np.sqrt(np.mean((near @ near.T - model.kernel(rest, rest)) ** 2)))
    return model


# Estimators


class Learner(Estimator):
    """An estimator over vectors and labels; ``fitted`` makes a predictor with ``classes`` and ``probabilities``."""

    def __init__(self, fitted: Callable, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, **settings):
        super().__init__()
        self.fitted, self.features, self.label, self.weight, self.settings = fitted, featuresCol, labelCol, weightCol, settings

    def with_settings(self, **more) -> Learner:
        names = {"weightCol": "weight", "featuresCol": "features", "labelCol": "label"}
        new = Learner(self.fitted, self.features, self.label, self.weight, **self.settings)
        for key, value in more.items():
            if key in names:
                setattr(new, names[key], value)
            else:
                new.settings[key] = value
        return new

    def _fit(self, dataset: DataFrame) -> Learned:
        rows, path, classes = staged_rows(dataset, self.features, self.label, self.weight)
        try:
            return Learned(self.fitted(rows, classes, **self.settings), self.features)
        finally:
            remove(dataset.sparkSession, path)


class Learned(Model):
    """Adds ``probability`` and ``prediction``, vectorised over Arrow batches; a null or incomplete vector gets null."""

    def __init__(self, predictor, features: str):
        super().__init__()
        self.predictor, self.features = predictor, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.predictor)

        @F.pandas_udf("struct<prediction: double, probability: array<double>>")
        def predict(vectors: pd.Series) -> pd.DataFrame:
            p = shared.value
            good = np.array([v is not None and not np.isnan(np.asarray(v, float)).any() for v in vectors], bool)
            shares = p.probabilities(np.stack(vectors[good].to_numpy()).astype(float)) if good.any() else np.zeros((0, len(p.classes)))
            best, lists = np.full(len(vectors), None, object), np.full(len(vectors), None, object)
            for i, at in enumerate(np.flatnonzero(good)):
                best[at], lists[at] = p.classes[int(shares[i].argmax())], shares[i].tolist()
            return pd.DataFrame({"prediction": pd.Series(best, dtype=object), "probability": pd.Series(lists, dtype=object)})

        made = dataset.withColumn("_learned", predict(entries(self.features)))
        return made.withColumns({"probability": F.when(F.col("_learned.probability").isNotNull(), array_to_vector("_learned.probability")), "prediction": F.col("_learned.prediction")}).drop("_learned")


def multiclass_boosting(rounds: int = 30, depth: int = 6, most_leaves: int = 64, bins: int = 64, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0, **cols) -> Learner:
    """Softmax boosting; the defaults grow level by level, ``most_leaves=31, depth=12, rate=0.1`` leaf by leaf."""
    return Learner(lambda rows, classes, **s: fit_boosted(rows, classes, **s), rounds=rounds, depth=depth, most_leaves=most_leaves, bins=bins, rate=rate, ridge=ridge, least=least, **cols)


def extra_trees(trees: int = 100, depth: int = 12, seed: int = 42, **cols) -> Learner:
    def fitted(rows: DataFrame, classes: list[float], **s) -> Voting:
        return fit_random_cuts(rows, classes, rows.select(F.size("x").alias("d")).first()["d"], **s)

    return Learner(fitted, trees=trees, depth=depth, seed=seed, **cols)


def ada_boost(rounds: int = 50, bins: int = 255, **cols) -> Learner:
    return Learner(fit_stumps, rounds=rounds, bins=bins, **cols)


def online(rule: str, epochs: int = 10, limit: float = 1.0, **cols) -> Learner:
    """``perceptron`` or ``passive_aggressive``; both end with averaged weights."""
    if rule not in ("perceptron", "passive_aggressive"):
        raise ValueError(f"unknown rule {rule!r}")
    return Learner(fit_online, rule=rule, epochs=epochs, limit=limit, **cols)


class RadialSVC(Estimator):
    """A radial-kernel support vector machine: Nystrom features, then Spark's linear one, one class against the rest."""

    def __init__(self, landmarks: int = 256, regParam: float = 0.01, maxIter: int = 50, seed: int = 42, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.landmarks, self.regParam, self.maxIter, self.seed, self.features, self.label = landmarks, regParam, maxIter, seed, featuresCol, labelCol

    def _fit(self, dataset: DataFrame) -> RadialSVCModel:
        rows, path, _ = staged_rows(dataset, self.features, self.label, None)
        try:
            kernel = fit_nystrom(rows, self.landmarks, self.seed)
            mapped = with_kernel(rows.select("x", F.col("y").cast("double").alias("label")), kernel, "x").drop("x")
            mapped = mapped.persist()
            machine = mc.OneVsRest(classifier=mc.LinearSVC(maxIter=self.maxIter, regParam=self.regParam, featuresCol="kernel_map"), featuresCol="kernel_map").fit(mapped)
            mapped.unpersist()
            labels = sorted(r["label"] for r in dataset.select(F.col(self.label).cast("double").alias("label")).where("label is not null").distinct().collect())
        finally:
            remove(dataset.sparkSession, path)
        return RadialSVCModel(kernel, machine, labels, self.features)


def with_kernel(df: DataFrame, kernel: Nystrom, column: str) -> DataFrame:
    """``df`` with ``kernel_map``, the kernel features of an array column; a batch is mapped ``KERNEL_ROWS`` rows at a time."""
    shared = df.sparkSession.sparkContext.broadcast(kernel)

    @F.pandas_udf("array<double>")
    def mapped(vectors: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(vectors), KERNEL_ROWS):
            out += list(shared.value.features(np.stack(vectors.iloc[i : i + KERNEL_ROWS].to_numpy()).astype(float)))
        return pd.Series(out, dtype=object)

    return df.withColumn("kernel_map", array_to_vector(mapped(F.col(column))))


class RadialSVCModel(Model):
    """Adds ``prediction``; a null or incomplete vector gets null."""

    def __init__(self, kernel: Nystrom, machine: mc.OneVsRestModel, classes: list[float], features: str):
        super().__init__()
        self.kernel, self.machine, self.classes, self.features = kernel, machine, classes, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = entries(self.features)
        known = F.coalesce(~F.exists(x, lambda v: F.isnan(v)), F.lit(False))
        blank = F.lit([0.0] * self.kernel.landmarks.shape[1])
        weights = np.stack([m.coefficients.toArray() for m in self.machine.models])
        shared = dataset.sparkSession.sparkContext.broadcast((self.kernel, weights, np.array([m.intercept for m in self.machine.models])))

        # All classes in one function: the machine's own transform starts a Python worker a class in every task.
        @F.pandas_udf("int")
        def best(vectors: pd.Series) -> pd.Series:
            kernel, weights, intercepts = shared.value
            out = [np.zeros(0, int)]
            for i in range(0, len(vectors), KERNEL_ROWS):
                x = np.stack(vectors.iloc[i : i + KERNEL_ROWS].to_numpy()).astype(float)
                out.append((kernel.features(x) @ weights.T + intercepts).argmax(1))
            return pd.Series(np.concatenate(out))

        found = dataset.withColumn("_best", best(F.when(known, x).otherwise(blank)))
        return found.withColumn("prediction", F.when(known, F.get(F.lit(self.classes), F.col("_best")))).drop("_best")
