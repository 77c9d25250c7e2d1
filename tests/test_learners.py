"""Learners against plain versions on a few hundred rows, and their independence of partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators import learners, models

N, D = 240, 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (N, D)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int) + ((x[:, 2] > 0.5) & (x[:, 3] < 0)).astype(int)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return models.with_features(spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(parts), "v", "y")


@pytest.fixture(scope="module")
def train(spark, data):
    return frame(spark, *data).cache()


def predictions(model, df):
    return {r.id: (r.prediction, tuple(r.probability.toArray())) for r in model.transform(df).select("id", "prediction", "probability").collect()}


def test_odd_rows_are_left_out_and_get_no_prediction(spark, train):
    from pyspark.ml.functions import array_to_vector

    odd = spark.createDataFrame([(900, None, 1.0), (901, [math.nan] * D, 0.0)], "id long, v array<double>, label double").withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector("v")))
    rows = train.select("id", "v", "label", "features").unionByName(odd.select("id", "v", "label", "features"))
    rows = rows.unionByName(train.where("id = 1").select(F.lit(902).cast("long").alias("id"), "v", F.lit(None).cast("double").alias("label"), "features"))
    a = models.estimator("extra_tree").fit(rows)
    b = models.estimator("extra_tree").fit(train)
    got = {r.id: r.prediction for r in a.transform(rows).collect()}
    assert got[900] is None and got[901] is None and got[902] == got[1]
    want = predictions(b, train)
    assert all(got[i] == want[i][0] for i in want)
    with pytest.raises(ValueError):
        models.estimator("extra_tree").fit(train.limit(0))
    one = models.estimator("xgboost").fit(train.where("label = 1"))
    assert {r.prediction for r in one.transform(train).collect()} == {1.0}


# Boosting


def plain_boosting(x, y, k, rounds, depth, rate, ridge, least):
    n, d = x.shape
    cuts = [np.unique(x[:, f])[:-1] for f in range(d)]
    share = np.bincount(y, minlength=k) / n
    margins = np.tile(np.log(share), (n, 1)) if k > 2 else np.full((n, 1), math.log(share[1] / share[0]))

    def grow(at, g, h, level):
        best = (1e-9, None)
        if level < depth and h[at].sum() >= 2 * least:
            for f in range(d):
                for t in cuts[f]:
                    l = at[x[at, f] <= t]
                    r = at[x[at, f] > t]
                    if len(l) and len(r) and h[l].sum() >= least and h[r].sum() >= least:
                        gain = g[l].sum() ** 2 / (h[l].sum() + ridge) + g[r].sum() ** 2 / (h[r].sum() + ridge) - g[at].sum() ** 2 / (h[at].sum() + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, (l, r))
        if best[1] is None:
            out = np.zeros(n)
            out[at] = -rate * g[at].sum() / (h[at].sum() + ridge)
            return out
        return grow(best[1][0], g, h, level + 1) + grow(best[1][1], g, h, level + 1)

    for _ in range(rounds):
        if k > 2:
            p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
            hit = y[:, None] == np.arange(k)
        else:
            p, hit = 1 / (1 + np.exp(-margins)), (y == 1)[:, None]
        margins = margins + np.stack([grow(np.arange(n), (p - hit)[:, c], (p * (1 - p))[:, c], 0) for c in range(margins.shape[1])], 1)
    if k > 2:
        return np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    p = 1 / (1 + np.exp(-margins))
    return np.hstack([1 - p, p])


@pytest.mark.parametrize("k", [2, 3])
def test_boosting_equals_a_plain_version(spark, data, k):
    x, y = data[0], np.minimum(data[1], k - 1)
    df = frame(spark, x, y)
    model = learners.multiclass_boosting(rounds=3, depth=3, bins=200, restage=2).fit(df)
    got, want = predictions(model, df), plain_boosting(x, y, k, 3, 3, 0.3, 1.0, 1.0)
    for i in range(N):
        assert np.allclose(got[i][1], want[i], atol=1e-9), i
    assert np.mean([got[i][0] == y[i] for i in range(N)]) > 0.9


def test_boosting_leaf_by_leaf_stops_at_its_leaves(spark, train, data):
    model = learners.multiclass_boosting(rounds=2, depth=10, most_leaves=5, least=0.1).fit(train)
    assert all((t.feature < 0).sum() <= 5 for r in model.predictor.trees for t in r)
    again = learners.multiclass_boosting(rounds=2, depth=10, most_leaves=5, least=0.1).fit(train.repartition(7))
    a, b = predictions(model, train), predictions(again, train)
    assert all(np.allclose(a[i][1], b[i][1], atol=1e-9) for i in a)


# Extra trees


def plain_random_tree(x, y, k, tree, depth, seed):
    some = max(1, int(math.sqrt(D)))
    out, number = np.zeros((len(x), k)), [1]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        later = []
        for node, at, level in sorted(todo, key=lambda t: t[0]):
            counts = np.bincount(y[at], minlength=k)
            best = None
            if level < depth and (counts > 0).sum() > 1:
                rng = np.random.default_rng([seed, tree, node])
                fs = rng.permutation(D)[:some]
                u = rng.random(some)
                for f, v in zip(fs, u):
                    lo, hi = x[at, f].min(), x[at, f].max()
                    t = lo + v * (hi - lo)
                    l, r = at[x[at, f] <= t], at[x[at, f] > t]
                    if hi > lo and len(l) and len(r):
                        gini = sum(len(s) - (np.bincount(y[s], minlength=k) ** 2).sum() / len(s) for s in (l, r))
                        if best is None or gini < best[0]:
                            best = (gini, l, r)
            if best is None:
                out[at] = counts / counts.sum()
            else:
                later += [(number[0], best[1], level + 1), (number[0] + 1, best[2], level + 1)]
                number[0] += 2
        todo = later
    return out


def test_extra_trees_equal_a_plain_version(spark, train, data):
    x, y = data
    model = learners.extra_trees(trees=4, depth=6, seed=5).fit(train)
    want = sum(plain_random_tree(x, y, 3, t, 6, 5) for t in range(4)) / 4
    got = predictions(model, train)
    assert all(np.allclose(got[i][1], want[i]) for i in range(N))
    assert predictions(learners.extra_trees(trees=4, depth=6, seed=5).fit(train.repartition(6)), train) == got


# AdaBoost


def test_ada_boost_equals_a_plain_version(spark, train, data):
    x, y = data
    w, stumps, k = np.ones(N), [], 3
    for _ in range(8):
        best = None
        for f in range(D):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                sides = [np.bincount(y[s], w[s], k) for s in (left, ~left)]
                gini = sum(c.sum() - (c**2).sum() / c.sum() for c in sides)
                if best is None or gini < best[0] - 1e-9:
                    best = (gini, f, t, int(sides[0].argmax()), int(sides[1].argmax()))
        guess = np.where(x[:, best[1]] <= best[2], best[3], best[4])
        error = w[guess != y].sum() / w.sum()
        vote = math.log((1 - error) / error) + math.log(k - 1)
        stumps.append((*best[1:], vote))
        w = w * np.exp(vote * (guess != y))
    model = learners.ada_boost(rounds=8).fit(train)
    assert len(model.predictor.stumps) == 8
    for got, want in zip(model.predictor.stumps, stumps):
        assert got[:4] == want[:4] and math.isclose(got[4], want[4], rel_tol=1e-9)
    votes = np.zeros((N, k))
    for f, t, a, b, v in stumps:
        votes[np.arange(N), np.where(x[:, f] <= t, a, b)] += v
    got = predictions(model, train)
    assert all(got[i][0] == votes[i].argmax() for i in range(N))


# Online


def test_online_passes_equal_a_plain_version_and_ignore_partitioning(spark, data):
    x, y = data[0], (data[0][:, 0] > data[0][:, 1]).astype(int)
    df = frame(spark, x, y)
    order = [r.id for r in df.orderBy(F.xxhash64("v", "y"), "id").collect()]
    for rule in ("perceptron", "passive_aggressive"):
        model = learners.online(rule, epochs=3).fit(df)
        w = np.zeros(D + 1)
        for _ in range(3):
            now, mean = w.copy(), np.zeros(D + 1)
            for i in order:
                row, s = np.append(x[i], 1.0), 1.0 if y[i] else -1.0
                m = s * (now @ row)
                now = now + ((m <= 0) * s if rule == "perceptron" else min(1.0, max(0.0, 1 - m) / (row @ row)) * s) * row
                mean += now
            w = mean / N
        assert np.allclose(model.predictor.weights[0], w)
        got = predictions(model, df)
        assert np.mean([got[i][0] == y[i] for i in range(N)]) > 0.9
        cut = [learners.online(rule, epochs=2).with_settings(shard=50).fit(d).predictor.weights for d in (df, df.repartition(7))]
        assert (cut[0] == cut[1]).all()
    with pytest.raises(ValueError):
        learners.online("other")


# Kernel machine


def test_radial_svc_separates_rings(spark):
    rng = np.random.default_rng(6)
    angle, y = rng.uniform(0, 2 * np.pi, 300), rng.integers(0, 2, 300)
    x = np.stack([np.cos(angle), np.sin(angle)], 1) * (1 + 2 * y + rng.normal(0, 0.2, 300))[:, None]
    df = frame(spark, x, 3 * y)
    model = learners.RadialSVC(landmarks=60).fit(df)
    assert model.kernel.error < 0.05 and math.isclose(model.kernel.gamma, 1 / (2 * x.var()))
    found = {r.id: r.prediction for r in model.transform(df).collect()}
    assert np.mean([found[i] == 3.0 * y[i] for i in range(300)]) > 0.97
    gap = df.unionByName(df.where("id = 1").withColumns({"id": F.lit(999).cast("long"), "features": F.lit(None).cast(df.schema["features"].dataType)}))
    assert {r.id: r.prediction for r in model.transform(gap).collect()} == {**found, 999: None}
    every = learners.RadialSVC(landmarks=300).fit(df)  # all rows: the kernel is exact
    near = every.kernel.features(x)
    assert np.abs(near @ near.T - every.kernel.kernel(x, x)).max() < 1e-6
    exact = {r.id: r.prediction for r in every.transform(df).collect()}
    assert np.mean([found[i] == exact[i] for i in range(300)]) > 0.97
