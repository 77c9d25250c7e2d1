"""The estimator zoo on ``pyspark.ml`` and on the learners that it lacks.

Names are the model families'; ``stand_in`` tells where Spark's nearest
estimator is another algorithm.  Families that Spark lacks are in
``learners``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml import classification as mc
from pyspark.ml.feature import Binarizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch_path
from . import learners
from .features import class_weights
from .filters import has_negative
from .metrics import sweep_metrics


@dataclass(frozen=True)
class Family:
    make: Callable[[], Estimator]
    scaled: bool = False
    stand_in: bool = False
    grid: dict | None = None


def _scaled(stage: Estimator) -> Estimator:
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), stage])


def _bernoulli() -> Estimator:
    return Pipeline(stages=[Binarizer(threshold=0.0, inputCol="features", outputCol="binary"), mc.NaiveBayes(modelType="bernoulli", featuresCol="binary")])


FAMILIES: dict[str, Family] = {
    "logistic_regression": Family(lambda: mc.LogisticRegression(maxIter=1000, featuresCol="scaled"), True, grid={"regParam": [0.01, 0.1, 1.0]}),
    "sgd_classifier": Family(lambda: mc.OneVsRest(classifier=mc.LinearSVC(maxIter=20, featuresCol="scaled"), featuresCol="scaled"), True, True),
    "linear_svc": Family(lambda: mc.OneVsRest(classifier=mc.LinearSVC(maxIter=30, featuresCol="scaled"), featuresCol="scaled"), True, grid={"regParam": [0.01, 0.1]}),
    "mlp": Family(lambda: mc.MultilayerPerceptronClassifier(maxIter=100, featuresCol="scaled", seed=42), True),
    "bernoulli_nb": Family(_bernoulli),
    "gaussian_nb": Family(lambda: mc.NaiveBayes(modelType="gaussian")),
    "multinomial_nb": Family(lambda: mc.NaiveBayes(modelType="multinomial"), grid={"smoothing": [0.1, 1.0]}),
    "complement_nb": Family(lambda: mc.NaiveBayes(modelType="complement")),
    "decision_tree": Family(lambda: mc.DecisionTreeClassifier(maxDepth=8, seed=42), grid={"maxDepth": [4, 8, 12]}),
    "random_forest": Family(lambda: mc.RandomForestClassifier(numTrees=100, seed=42), grid={"numTrees": [50, 100]}),
    "gradient_boosting": Family(lambda: mc.GBTClassifier(maxIter=20, seed=42)),
    "hist_gradient_boosting": Family(lambda: learners.multiclass_boosting(rounds=15, depth=8, most_leaves=31, bins=255, rate=0.1), grid={"rate": [0.1, 0.3]}),
    "xgboost": Family(lambda: learners.multiclass_boosting(rounds=15, depth=6), grid={"rate": [0.1, 0.3]}),
    "lightgbm": Family(lambda: learners.multiclass_boosting(rounds=15, depth=8, most_leaves=31, bins=255, rate=0.1, least=1e-3), grid={"most_leaves": [15, 31]}),
    "extra_trees": Family(learners.extra_trees, grid={"trees": [50, 100]}),
    "extra_tree": Family(lambda: learners.extra_trees(trees=1)),
    "ada_boost": Family(learners.ada_boost, grid={"rounds": [25, 50]}),
    "perceptron": Family(lambda: learners.online("perceptron", featuresCol="scaled"), True),
    "passive_aggressive": Family(lambda: learners.online("passive_aggressive", featuresCol="scaled"), True, grid={"limit": [0.1, 1.0]}),
    "rbf_svc": Family(lambda: learners.RadialSVC(featuresCol="scaled"), True),
    "bagging": Family(lambda: mc.RandomForestClassifier(numTrees=100, featureSubsetStrategy="all", seed=42)),
}


def estimator(name: str, n_features: int = 0, n_classes: int = 2, params: dict | None = None) -> Estimator:
    """A fresh pipeline over ``features, label``; ``params`` belong to the classifier itself."""
    family = FAMILIES[name]
    stage = family.make()
    if isinstance(stage, learners.Learner):
        stage = stage.with_settings(**(params or {}))
        return _scaled(stage) if family.scaled else stage
    tuned = stage.getClassifier() if isinstance(stage, mc.OneVsRest) else stage
    for key, value in (params or {}).items():
        tuned.set(tuned.getParam(key), value)
    if name == "mlp":
        stage.setLayers([n_features, max(8, n_features // 2), n_classes])
    return _scaled(stage) if family.scaled else stage


def with_features(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.withColumns({"features": array_to_vector(F.transform(vector, lambda x: x.cast("double"))), "label": F.col(label).cast("double")})


#: Families that take a weight a row, for classes of uneven size.
WEIGHTED = {"logistic_regression", "decision_tree", "random_forest", "extra_trees", "extra_tree", "bagging", "sgd_classifier", "linear_svc", "ada_boost", "xgboost", "lightgbm", "hist_gradient_boosting"}
#: Families that count and so take no negative feature.
COUNTING = {"multinomial_nb", "complement_nb"}


def balanced(train: DataFrame) -> DataFrame:
    """Column ``weight``: ``n / (k * n_c)`` of the row's class, from the few classes' counts."""
    weights = class_weights(train, "label").withColumnRenamed("label", "__label")
    return train.join(F.broadcast(weights), F.col("label") == F.col("__label")).drop("__label")


#: What a family's own data or settings cause; anything else may be a passing fault of the cluster.
DATA_ERRORS = (ValueError, KeyError, TypeError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException, AnalysisException)


def fitted_once_more(fit: Callable[[], Model]) -> Model:
    """What ``fit`` gives, tried a second time where the first failure is none of its data's."""
    try:
        return fit()
    except DATA_ERRORS:
        raise
    except Exception:
        return fit()


def sweep(train: DataFrame, test: DataFrame, names: Iterable[str], id_col: str, n_features: int, n_classes: int, balance: bool = False, at_once: int = 4) -> tuple[DataFrame | None, dict[str, str]]:
    """Fit each family and predict the test rows: long ``model, id, gt, pred``, and every family's status.

    A failing family never ends the sweep: its status tells why, and is ``OK``
    otherwise; what its data didn't cause is tried twice.  ``at_once`` families
    are fitted at the same time.  Both sides are written once: read back, they
    lie in as many partitions as their bytes call for, however many the plan
    that made them shuffled into.  Counting families are skipped where a
    training feature is negative.  ``balance`` weighs rows by class for the
    families that take weights.
    """
    names = list(names)
    spark, paths, written = train.sparkSession, [], []
    for d in (balanced(train) if balance else train, test):
        paths.append(scratch_path(spark, "sweep"))
        d.write.parquet(paths[-1])
        written.append(spark.read.schema(d.schema).parquet(paths[-1]))
    train, test = written[0].persist(), written[1]
    negative = has_negative(train.select(vector_to_array("features").alias("v")), "v") if COUNTING & set(names) else False
    params = {"weightCol": "weight"}

    @inheritable_thread_target(train.sparkSession)
    def run(name: str) -> tuple[DataFrame | None, str]:
        if negative and name in COUNTING:
            return None, "SKIPPED: negative features"
        try:
            fitted = fitted_once_more(lambda: estimator(name, n_features, n_classes, params if balance and name in WEIGHTED else None).fit(train))
            return fitted.transform(test).select(F.lit(name).alias("model"), id_col, F.col("label").cast("int").alias("gt"), F.col("prediction").cast("int").alias("pred")), "OK"
        except Exception as error:
            return None, f"FAILED: {type(error).__name__}: {str(error).splitlines()[0][:200]}"

    with ThreadPoolExecutor(at_once) as pool:
        found = dict(zip(names, pool.map(run, names)))
    out = None
    for rows, _ in found.values():
        out = rows if out is None else out if rows is None else out.unionByName(rows)
    train.unpersist()
    remove(spark, paths[0])
    return out, {name: status for name, (_, status) in found.items()}


def sweep_table(rows: DataFrame | None, status: dict[str, str], labels: list[int]) -> DataFrame:
    """One row a family of the sweep: ``model, status`` and its metrics, null where it didn't run."""
    spark = rows.sparkSession if rows is not None else SparkSession.active()
    every = spark.createDataFrame(sorted(status.items()), "model string, status string")
    return every if rows is None else every.join(sweep_metrics(rows, labels, ["model"]), "model", "left")


def sweep_labels(train: DataFrame, test: DataFrame, labels: list[str], name: str, id_col: str, n_features: int) -> DataFrame:
    """One binary estimator a label: long ``id, label, gt, pred, score`` of the test rows; ``train`` and ``test`` have ``features`` and the labels."""
    parts = []
    for label in labels:
        target = F.col(label).cast("double")
        fitted = estimator(name, n_features, 2).fit(train.withColumn("label", target))
        rows = fitted.transform(test.withColumn("label", target))
        score = F.element_at(vector_to_array("probability"), -1) if "probability" in rows.columns else F.col("prediction")
        parts.append(rows.select(id_col, F.lit(label).alias("label"), F.col(label).cast("int").alias("gt"), F.col("prediction").cast("int").alias("pred"), score.alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    """A saved model of whatever class it was saved as."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())


def cross_validate(train: DataFrame, name: str, id_col: str, folds: int = 5, n_features: int = 0, n_classes: int = 2, seed: int = 42, params: dict | None = None) -> list[float]:
    """Accuracy of each fold; folds go by a hash of the id."""
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(folds))
    scores = []
    for k in range(folds):
        fitted = estimator(name, n_features, n_classes, params).fit(train.where(fold != k))
        held = fitted.transform(train.where(fold == k))
        scores.append(held.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])
    return scores


def search(train: DataFrame, name: str, id_col: str, how: str = "grid", n_iter: int = 15, folds: int = 3, n_features: int = 0, n_classes: int = 2, seed: int = 42) -> tuple[dict, list[tuple[dict, float, float]]]:
    """Best parameters of a family and every tried set with its mean and population deviation over folds.

    ``none`` tries the defaults, ``grid`` the family's whole grid, ``random``
    ``n_iter`` of its sets in a seeded order.  The first best set wins.
    """
    if how not in ("none", "grid", "random"):
        raise ValueError(f"unknown search {how!r}")
    grid = (FAMILIES[name].grid or {}) if how != "none" else {}
    sets = [dict(zip(grid, values)) for values in product(*grid.values())]
    if how == "random":
        sets = sorted(sets, key=lambda s: hashlib.md5(f"{seed}:{sorted(s.items())}".encode()).hexdigest())[:n_iter]
    tried = []
    for params in sets:
        scores = cross_validate(train, name, id_col, folds, n_features, n_classes, seed, params)
        tried.append((params, float(np.mean(scores)), float(np.std(scores))))
    return max(tried, key=lambda t: t[1])[0], tried


def moments(rows: DataFrame, group: str, vector: str) -> dict:
    """Count, sum and sum of outer products of the vectors of each group (null left out).

    A task sends on one matrix a group, and Spark adds these up cell by cell.
    """

    def work(batches):
        held: dict = {}
        for batch in batches:
            groups = batch[group].to_numpy()
            x = np.stack(batch[vector].to_numpy()).astype(float) if len(batch) else np.zeros((0, 0))
            for c in np.unique(groups):
                part = x[groups == c]
                n, s, p = held.get(c, (0, 0.0, 0.0))
                held[c] = n + len(part), s + part.sum(0), p + part.T @ part
        yield pd.DataFrame([(int(c), -1, float(n)) for c, (n, _, _) in held.items()] + [(int(c), i, float(v)) for c, (_, s, p) in held.items() for i, v in enumerate([*s, *p.ravel()])], columns=["g", "i", "v"])

    known = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    cells = known.mapInPandas(work, "g long, i long, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).collect()  # (d * d + d + 1) numbers a group
    out: dict = {}
    for r in cells:
        out.setdefault(r["g"], {})[r["i"]] = r["v"]
    found = {}
    for g, values in out.items():
        d = int((-1 + (1 + 4 * (len(values) - 1)) ** 0.5) / 2)
        flat = np.array([values[i] for i in range(d + d * d)])
        found[g] = int(values[-1]), flat[:d], flat[d:].reshape(d, d)
    return found


def gaussian_discriminant(train: DataFrame, vector: str, label: str, quadratic: bool = False, ridge: float = 1e-3) -> dict:
    """Linear or quadratic discriminant analysis from per-class sums alone.

    Tasks sum ``x`` and ``x x^T`` per class, one matrix a task; the driver adds
    these up and inverts the covariances.
    """
    sums = moments(train.select(F.col(label).cast("int").alias("c"), vector), "c", vector)
    size = {c: n for c, (n, _, _) in sums.items()}
    d = max((len(s) for _, s, _ in sums.values()), default=0)
    mean = {c: s / n for c, (n, s, _) in sums.items()}
    scatter = {c: p for c, (_, _, p) in sums.items()}
    total = sum(size.values())
    within = {c: scatter[c] - size[c] * np.outer(mean[c], mean[c]) for c in size}
    pooled = sum(within.values()) / max(1, total - len(size)) + ridge * np.eye(d) if size else np.eye(d)
    cov = {c: within[c] / max(1, size[c] - 1) + ridge * np.eye(d) if quadratic else pooled for c in size}
    return {c: (mean[c], np.linalg.inv(cov[c]), np.linalg.slogdet(cov[c])[1], np.log(size[c] / total)) for c in size}


def discriminant_predict(df: DataFrame, model: dict, vector: str) -> DataFrame:
    """``pred``: the class of highest discriminant, vectorised over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def predict(vectors):
        x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 0))
        classes = sorted(shared.value)
        scores = np.stack([p - 0.5 * (np.einsum("ij,jk,ik->i", x - m, inv, x - m) + det) for m, inv, det, p in (shared.value[c] for c in classes)], 1)
        return pd.Series(np.array(classes)[scores.argmax(1)])

    return df.withColumn("pred", predict(F.col(vector)))


def ridge_scores(train: DataFrame, vector: str, n_features: int, alpha: float = 1.0) -> np.ndarray:
    """Weights (intercept last) of a ridge classifier on +-1 targets ``y``, from one pass of summed products."""
    x = F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(F.lit(1.0), F.col("y").cast("double")))
    _, _, p = moments(train.select(F.lit(0).alias("g"), x.alias("x")), "g", "x").get(0, (0, None, np.zeros((n_features + 2,) * 2)))
    a, b = p[:-1, :-1], p[:-1, -1]
    penalty = alpha * np.eye(n_features + 1)
    penalty[-1, -1] = 0.0
    return np.linalg.solve(a + penalty, b)


def isotonic_calibration(scores: DataFrame, score: str = "score", gt: str = "gt") -> Model:
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=score, labelCol=gt).fit(scores.select(F.col(score).cast("double"), F.col(gt).cast("double")))


def native_importance(model: Model, k: int = 20) -> list[tuple[int, float]]:
    """The ``k`` most important features of a tree model; empty for others."""
    values = getattr(model, "featureImportances", None)
    if values is None:
        return []
    ranked = sorted(enumerate(values.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return ranked[:k]


def surrogate(black_box: DataFrame, prediction: str = "pred", depth: int = 4) -> tuple[Model, str]:
    """A shallow tree fitted to a model's predictions, and its rules as text."""
    tree = mc.DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=5, labelCol="__y", seed=42)
    fitted = tree.fit(black_box.withColumn("__y", F.col(prediction).cast("double")))
    return fitted, fitted.toDebugString


def fidelity(model: Model, rows: DataFrame, prediction: str = "pred") -> DataFrame:
    hit = F.col("prediction").cast("int") == F.col(prediction)
    return model.transform(rows).agg(F.avg(hit.cast("int")).alias("fidelity"))


def permutation_importance(model: Model, rows: DataFrame, id_col: str, n_features: int, repeats: int = 3, seed: int = 42, most: int = 100) -> DataFrame:
    """``feature, mean_drop, std_drop`` of accuracy when one feature is shuffled among rows.

    Rows take the value of their successor in a seeded hash order, cut into
    hash ranges so that no window holds all rows.  Wider inputs than ``most``
    are refused.
    """
    if n_features > most:
        raise ValueError(f"{n_features} features; permutation importance is bounded at {most}")
    from pyspark.sql import Window

    base = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    values = rows.withColumn("__a", vector_to_array("features"))
    drops = []
    for r in range(repeats):
        h = F.xxhash64(F.lit(seed + r), F.col(id_col))
        ranged = Window.partitionBy(F.pmod(h, F.lit(64))).orderBy(h)
        moved = values.withColumn("__b", F.coalesce(F.lead("__a").over(ranged), F.first("__a").over(ranged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        long = moved.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))))
        changed = F.transform("__a", lambda x, i: F.when(i == F.col("feature"), F.element_at("__b", i + 1)).otherwise(x))
        scored = model.transform(long.withColumn("features", array_to_vector(changed)).drop("__a", "__b"))
        drops.append(scored.groupBy("feature").agg((F.lit(base) - F.avg((F.col("prediction") == F.col("label")).cast("int"))).alias("drop")))
    every = drops[0]
    for d in drops[1:]:
        every = every.unionByName(d)
    return every.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))


def linear_shap(df: DataFrame, train: DataFrame, id_col: str, vector: str, weights: list[float]) -> DataFrame:
    """``id, shap array``: ``w * (x - mean(x))``, exact for linear models."""
    mean = train.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    whole = F.broadcast(mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("__m")))
    w = F.lit([float(x) for x in weights])
    centred = F.zip_with(vector, "__m", lambda x, m: x.cast("double") - m)
    return df.crossJoin(whole).select(id_col, F.zip_with(w, centred, lambda a, b: a * b).alias("shap"))
