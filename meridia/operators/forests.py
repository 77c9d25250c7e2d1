"""Tables of decision trees: taken from ``pyspark.ml`` models, and Shapley values over them.

A tree is a table of nodes; its leaves are boxes of feature space.  The
path-dependent Shapley value of a leaf's feature is a weighted sum over subsets
of the leaf's other features, which equals the integral over t in [0, 1] of a
polynomial in t: of a subset's features those kept hold with weight t, those
averaged out with weight 1 - t.  Gauss-Legendre nodes integrate it exactly, so
all leaves and rows of a batch are handled by array operations, without
enumerating subsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path

#: Doubles that one block of rows and leaves may fill at a time.
BLOCK = 2_000_000


@dataclass
class TreeTable:
    """Nodes by number, the root first; ``feature`` is -1 at a leaf, rows with ``x <= threshold`` go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        inner = self.feature[at] >= 0
        while inner.any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            inner = self.feature[at] >= 0
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(x)]

    def mean(self) -> np.ndarray:
        leaf = self.feature < 0
        return self.cover[leaf] @ self.value[leaf] / self.cover[0]


class LeafBoxes:
    """The leaves of a tree as boxes: for each leaf its distinct path features, their bounds and shares of cover."""

    def __init__(self, tree: TreeTable):
        paths, todo = [], [(0, {})]
        while todo:
            node, path = todo.pop()
            f = int(tree.feature[node])
            if f < 0:
                paths.append((node, path))
                continue
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            t = tree.threshold[node]
            for child, bounds in ((tree.left[node], (lo, min(hi, t))), (tree.right[node], (max(lo, t), hi))):
                if tree.cover[child] > 0:
                    todo.append((int(child), {**path, f: (*bounds, share * tree.cover[child] / tree.cover[node])}))
        width = max((len(p) for _, p in paths), default=0)
        #: Unused places hold feature 0 without bounds and a share of 1, which adds nothing.
        self.features = np.zeros((len(paths), width), np.int64)
        self.lo, self.hi = np.full((len(paths), width), -np.inf), np.full((len(paths), width), np.inf)
        self.share = np.ones((len(paths), width))
        self.values = np.stack([tree.value[node] for node, _ in paths])
        for i, (_, path) in enumerate(paths):
            for j, (f, (lo, hi, share)) in enumerate(path.items()):
                self.features[i, j], self.lo[i, j], self.hi[i, j], self.share[i, j] = f, lo, hi, share
        nodes, weights = np.polynomial.legendre.leggauss(max(1, (width + 1) // 2))
        self.t, self.w = (nodes + 1) / 2, weights / 2

    def add_shapley(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add the values of each row to ``out``: rows, features, outputs."""
        leaves, width = self.features.shape
        if not width:
            return
        step = max(1, BLOCK // (leaves * width))
        used = np.unique(self.features)
        spots = [np.nonzero(self.features == f) for f in used.tolist()]
        for i in range(0, len(x), step):
            part = x[i : i + step][:, self.features]
            holds = (part > self.lo) & (part <= self.hi)
            total = np.zeros(holds.shape)
            for t, w in zip(self.t, self.w):
                factor = self.share * (1 - t) + holds * t
                total += w * factor.prod(2, keepdims=True) / factor
            total *= holds - self.share
            for f, (leaf, place) in zip(used.tolist(), spots):
                out[i : i + step, f] += total[:, leaf, place] @ self.values[leaf]


def forest_tables(model: Model) -> list[TreeTable]:
    """The trees of a fitted ``pyspark.ml`` tree model, scaled so that their values add up to what it predicts.

    Classifiers of one tree and random forests give class probabilities;
    boosted trees give the margin, and regressors the prediction.  The nodes
    are read from the model as it is saved, and its size alone decides theirs.
    """
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "treeID" not in rows.columns:
        rows = rows.select(F.lit(0).alias("treeID"), F.struct(*rows.columns).alias("nodeData"))
    trees: dict[int, list] = {}
    for r in rows.select("treeID", "nodeData.*").orderBy("treeID", "id").toLocalIterator():
        trees.setdefault(r["treeID"], []).append(r)
    classes = getattr(model, "numClasses", 0) if not hasattr(model, "treeWeights") or "Forest" in type(model).__name__ else 0
    weights = list(getattr(model, "treeWeights", [1.0]))
    if "Forest" in type(model).__name__:
        weights = [1.0 / len(weights)] * len(weights)
    out = []
    for number, nodes in sorted(trees.items()):
        place = {r["id"]: i for i, r in enumerate(nodes)}
        stats = [np.array(r["impurityStats"]) for r in nodes]
        leaf = [r["leftChild"] < 0 for r in nodes]
        if any(not end and r["split"]["numCategories"] >= 0 for end, r in zip(leaf, nodes)):
            raise ValueError("splits on categories aren't tabulated")
        value = np.stack([s / s.sum() for s in stats]) if classes else np.array([[r["prediction"]] for r in nodes])
        out.append(
            TreeTable(
                np.array([-1 if end else r["split"]["featureIndex"] for end, r in zip(leaf, nodes)]),
                np.array([0.0 if end else r["split"]["leftCategoriesOrThreshold"][0] for end, r in zip(leaf, nodes)]),
                np.array([0 if end else place[r["leftChild"]] for end, r in zip(leaf, nodes)]),
                np.array([0 if end else place[r["rightChild"]] for end, r in zip(leaf, nodes)]),
                np.array([s.sum() if classes else s[0] for s in stats]),
                weights[number] * value,
            )
        )
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles; rows of another width or with nulls are NaN."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = lengths == width
    out = np.full((len(column), width), np.nan)
    if good.any():
        out[good] = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def tree_shap(rows: DataFrame, trees: list[TreeTable], id_col: str, vector_col: str, n_features: int) -> DataFrame:
    """``id, output, base, prediction, shap array<double>``: a row for every row and output of the trees.

    ``shap`` sums to ``prediction - base``, where ``base`` is the mean over the
    training rows the trees' covers count.  The trees are sent to each task
    once.  Missing vectors, those of another width and those with null or NaN
    entries get null results; repeated rows and ids keep their rows.
    """
    outputs = trees[0].value.shape[1] if trees else 0
    schema = T.StructType([rows.schema[id_col], *[T.StructField("output", T.IntegerType())], *[T.StructField(c, T.DoubleType()) for c in ("base", "prediction")], T.StructField("shap", T.ArrayType(T.DoubleType()))])
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = [LeafBoxes(t) for t in shared.value]
        base = sum(t.mean() for t in shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                x = matrix(part.column(1), n_features)
                known = ~np.isnan(x).any(1)
                x = np.where(known[:, None], x, 0.0)
                values, guess = np.zeros((len(x), n_features, outputs)), sum(t.predict(x) for t in shared.value)
                for b in boxes:
                    b.add_shapley(x, values)
                lost = np.repeat(~known, outputs)
                flat = pa.array(list(values.transpose(0, 2, 1).reshape(-1, n_features)), pa.list_(pa.float64()), mask=lost)
                cells = [part.column(0).take(pa.array(np.repeat(np.arange(len(x)), outputs))), pa.array(np.tile(np.arange(outputs, dtype=np.int32), len(x))), pa.array(np.tile(base, len(x))), pa.array(guess.ravel(), mask=lost), flat]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return rows.select(id_col, vector_col).mapInArrow(work, schema)
