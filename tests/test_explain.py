"""Tree Shapley values against subsets written out, and local linear explanations against linear models."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meridia.operators import forests, lime, models

D = 6


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (300, D)) + 0.5 * rng.random((300, D))
    y = ((x[:, 0] > 2) & (x[:, 1] > 1) | (x[:, 2] * x[:, 3] > 9)).astype(int) + (x[:, 4] > 4)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    return models.with_features(df, "v", "y").cache()


def conditional(tree, x, known):
    """Mean of the tree where only the features in ``known`` are looked at."""

    def at(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return at(left if x[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * at(left) + tree.cover[right] * at(right)) / tree.cover[node]

    return at(0)


def plain_shapley(trees, x):
    out = np.zeros((D, trees[0].value.shape[1]))
    for i in range(D):
        others = [f for f in range(D) if f != i]
        for size in range(D):
            for s in combinations(others, size):
                w = math.factorial(size) * math.factorial(D - size - 1) / math.factorial(D)
                out[i] += w * sum(conditional(t, x, {*s, i}) - conditional(t, x, set(s)) for t in trees)
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "regression"])
def test_tree_shap_equals_subsets(spark, train, kind):
    binary = train.withColumn("label", (F.col("label") > 0).cast("double"))
    model = {
        "tree": lambda: mc.DecisionTreeClassifier(maxDepth=6, seed=1).fit(train),
        "forest": lambda: mc.RandomForestClassifier(numTrees=5, maxDepth=5, seed=1).fit(train),
        "boosted": lambda: mc.GBTClassifier(maxIter=4, maxDepth=4, seed=1).fit(binary),
        "regression": lambda: mr.RandomForestRegressor(numTrees=3, maxDepth=5, seed=1).fit(train),
    }[kind]()
    trees = forests.forest_tables(model)
    some = train.where("id < 12").select("id", "v")
    some = some.unionByName(spark.createDataFrame([(100, None), (101, [1.0]), (102, [1.0, None] * 3)], "id long, v array<double>"))
    got = forests.tree_shap(some, trees, "id", "v", D).collect()
    guess = {r.id: r for r in model.transform(train).collect()}
    assert len(got) == 15 * trees[0].value.shape[1]
    for r in got:
        if r.id >= 100:
            assert r.shap is None and r.prediction is None and r.base is not None
            continue
        x = np.array(guess[r.id].v)
        assert np.allclose(r.shap, plain_shapley(trees, x)[:, r.output], atol=1e-10)
        assert math.isclose(sum(r.shap), r.prediction - r.base, abs_tol=1e-10)
        if kind in ("tree", "forest"):
            assert math.isclose(r.prediction, guess[r.id].probability[r.output], abs_tol=1e-10)
        elif kind == "regression":
            assert math.isclose(r.prediction, guess[r.id].prediction, abs_tol=1e-10)
        else:
            assert (r.prediction > 0) == (guess[r.id].prediction == 1.0)


def test_a_tree_without_a_split_explains_nothing(spark, train):
    trees = forests.forest_tables(mc.DecisionTreeClassifier(maxDepth=0).fit(train))
    rows = forests.tree_shap(train.limit(2), trees, "id", "v", D).collect()
    assert all(r.shap == [0.0] * D and r.prediction == r.base for r in rows)
    assert forests.tree_shap(train.limit(0), trees, "id", "v", D).collect() == []


def test_lime_recovers_a_model_that_is_linear_in_the_flags(spark, train):
    edges = lime.quartile_edges(train, "v")
    assert edges.shape == (D, 5) and (np.diff(edges) >= 0).all()
    weights = [2.0, -1.0, 0.5, 0.0, 3.0, -0.25]
    predict = lambda df: df.withColumn("score", F.aggregate(F.zip_with("flags", F.lit(weights), lambda a, b: a * b), F.lit(0.75), lambda s, v: s + v))
    rows = train.where("id < 9").unionByName(train.where("id = 3")).withColumn("v", F.when(F.col("id") == 5, None).otherwise(F.col("v")))
    got = lime.explain_rows(rows, train, predict, "id", "v", samples=200, ridge=1e-9).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 3, 4, 6, 7, 8]
    for r in got:
        assert np.allclose(r.weights, weights, atol=1e-6) and math.isclose(r.intercept, 0.75, abs_tol=1e-6) and r.fit > 1 - 1e-9
    again = lime.explain_rows(rows.repartition(5), train, predict, "id", "v", samples=200, ridge=1e-9).collect()
    assert {(r.id, tuple(r.weights)) for r in got} == {(r.id, tuple(r.weights)) for r in again}


def test_lime_matrices_equal_a_plain_sum_over_samples(spark, train):
    model = mc.DecisionTreeClassifier(maxDepth=5, seed=1).fit(train.withColumn("label", (F.col("label") > 0).cast("double")))
    predict = lambda df: model.transform(df.withColumn("features", array_to_vector("vector"))).withColumn("score", F.col("prediction"))
    edges = lime.quartile_edges(train, "v")
    trees = forests.forest_tables(model)
    rows = {r.id: np.array(r.v) for r in train.where("id < 4").collect()}
    got = lime.explain_rows(train.where("id < 4"), train, predict, "id", "v", samples=60).collect()
    assert len(got) == 4
    for r in got:
        u = np.array([lime.draws(42, r.id, 60, D)[s] for s in range(60)])
        values, flags = lime.perturbed(rows[r.id], edges, u)
        assert (values[0] == rows[r.id]).all() and flags[0].all()
        for v, f in zip(values, flags):
            own, drawn = (rows[r.id][:, None] > edges[:, 1:4]).sum(1), (v[:, None] > edges[:, 1:4]).sum(1)
            assert ((own == drawn) >= f.astype(bool)).mean() > 0.8
        z, y = np.hstack([flags, np.ones((60, 1))]), (trees[0].predict(values)[:, 1] > 0.5).astype(float)
        w = np.array([math.sqrt(math.exp(-(D - f.sum()) / (0.75**2 * D))) for f in flags])
        normal = sum(a * np.outer(b, b) for a, b in zip(w, z))
        assert np.allclose(np.array(r.normal).reshape(D + 1, D + 1), normal)
        penalty = np.diag([1.0] * D + [1e-12])
        assert np.allclose([*r.weights, r.intercept], np.linalg.solve(normal + penalty, z.T @ (w * y)))


def test_text_explanations_find_the_words_that_count(spark):
    texts = [(1, "good day and a bad night for a good dog"), (2, ""), (3, None), (4, "bad"), (5, "wort " * 3000 + "good")]
    df = spark.createDataFrame(texts, "id long, text string")
    count = lambda w: F.size(F.filter(F.split("text", r"\s+"), lambda t: t == w))
    predict = lambda d: d.withColumn("score", (count("good") > 0).cast("double") - 2.0 * (count("bad") > 0).cast("double"))
    got = {r.id: r for r in lime.explain_texts(df, predict, "id", "text", samples=300, ridge=1e-6).collect()}
    assert set(got) == {1, 4, 5}
    found = dict(zip(lime.words_of(texts[0][1]), got[1].weights))
    assert abs(found["good"] - 1) < 0.01 and abs(found["bad"] + 2) < 0.01 and max(abs(v) for k, v in found.items() if k not in ("good", "bad")) < 0.01
    assert abs(dict(zip(lime.words_of(texts[4][1]), got[5].weights))["good"] - 1) < 0.01
