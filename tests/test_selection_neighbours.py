"""Order statistics and pivot search against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators import features, neighbours, selection


def test_order_statistics_of_awkward_columns(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in np.round(rng.normal(0, 1e3, 300), 1)] + [0.0, -0.0, 1e-310, -1e308, 1e308, math.inf, -math.inf] + [7.5] * 100
    rows = [(v, int(v) if math.isfinite(v) and abs(v) < 1e6 else None, None, 3.0) for v in x]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(4)
    a, b = sorted(x), sorted(r[1] for r in rows if r[1] is not None)
    found = selection.order_statistics(df, {"a": [0, 5, 200, len(a) - 1], "b": [0, 150], "d": [2]})
    assert found == {"a": {i: a[i] for i in (0, 5, 200, len(a) - 1)}, "b": {0: b[0], 150: b[150]}, "d": {2: 3.0}}
    got = selection.exact_quantiles(df.where("abs(a) < 1e300"), {"a": [0.0, 0.25, 0.5, 0.9, 1.0], "b": [0.5], "c": [0.5]})
    finite = [v for v in x if abs(v) < 1e300]
    assert np.allclose(got["a"], np.quantile(finite, [0, 0.25, 0.5, 0.9, 1])) and got["b"] == [float(np.median(b))] and got["c"] == [None]
    with pytest.raises(IndexError):
        selection.order_statistics(df, {"d": [10_000]})
    keys = selection.sortable(np.array([-math.inf, -1.0, -1e-310, -0.0, 0.0, 5.0, math.inf, math.nan]))
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[3] == keys[4] and [selection.value_of(int(k)) for k in keys[:7]] == [-math.inf, -1.0, -1e-310, 0.0, 0.0, 5.0, math.inf]


def test_robust_scaling_and_medians_equal_sparks_own(spark):
    df = spark.range(501).select("id", F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("y"))
    q = df.agg(F.median("x").alias("m"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("s"), F.median("y").alias("f")).first()
    got = {r.id: r.x for r in features.scale(df, df, ["x"], "robust").collect()}
    assert all(math.isclose(got[r.id], (r.x - q.m) / q.s, abs_tol=1e-12) for r in df.collect())
    filled = features.impute_numeric(df, df, ["y"], "mean")
    assert {r.y for r in filled.where("id % 4 = 0").collect()} == {q.f} and filled.columns == df.columns


def plain_nearest(queries, rows, k, metric, places):
    out = set()
    for q, a in queries:
        found = []
        for i, b in rows:
            if i != q:
                if metric == "euclidean":
                    d = ((b - a) ** 2).sum()
                else:
                    norm = np.linalg.norm(a) * np.linalg.norm(b)
                    d = -(a @ b) / norm if norm else 0.0
                found.append((float(np.round(d, places)), i))
        out |= {(q, i, d, rank + 1) for rank, (d, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("kind", ["clustered", "random", "equal"])
def test_pivot_search_is_exact(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (8, 6))
    x = {"clustered": lambda: centres[rng.integers(0, 8, 240)] + rng.normal(0, 0.1, (240, 6)), "random": lambda: rng.normal(0, 1, (240, 6)), "equal": lambda: np.tile(rng.normal(0, 1, (4, 6)), (60, 1))}[kind]()
    x[[3, 50]] = 0.0
    rows = [(i, x[i]) for i in range(240)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "id long, v array<double>").repartition(3)
    asked = df.where("id % 10 = 0 or id = 3")
    got = {(r.q, r.id, r.d + 0.0, r["rank"]) for r in neighbours.nearest(asked, df, "id", "v", 5, metric, places=6).collect()}
    want = {(q, i, d + 0.0, r) for q, i, d, r in plain_nearest([rows[i] for i in range(240) if i % 10 == 0 or i == 3], rows, 5, metric, 6)}
    assert got == want
    work = neighbours.searched_blocks(asked.where("id not in (3, 50)"), df, "id", "v", 5, metric).agg(F.sum("searched").alias("s"), F.sum("blocks").alias("b")).first()
    assert work.s <= work.b and (kind != "clustered" or work.s < 0.4 * work.b)


def test_pivot_search_of_small_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert {(r.q, r.id) for r in neighbours.nearest(df, df, "id", "v", 5).collect()} == {(1, 2), (2, 1)}
    assert neighbours.nearest(df.limit(0), df, "id", "v", 5).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest(df, df, "id", "v", 1, "other")
