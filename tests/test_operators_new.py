"""Running totals, neighbours, filters, sweeps and saved models against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions.binding import once
from meridia.operators import detection, filters, metrics, models, neighbours, ranges, sampling
from meridia.sources import readers, writers


@pytest.fixture()
def small_ranges(monkeypatch):
    """Ranges so short that small tables take many."""
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 25)


def test_running_totals_over_many_ranges(spark, small_ranges):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 4)), i, int(rng.integers(0, 9))) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, s double, id int, v long").repartition(5)
    for inclusive in (True, False):
        got = {r.id: r.total for r in ranges.running_totals(df, ["g"], ["s", "id"], {"v": "total"}, inclusive).collect()}
        for g, s, i, _ in rows:
            want = sum(r[3] for r in rows if r[0] == g and ((r[1], r[2]) <= (s, i) if inclusive else (r[1], r[2]) < (s, i)))
            assert got[i] == want
    assert df.select(ranges.range_of(df, ["s", "id"]).alias("r")).distinct().count() > 10


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "g int, s double, v long")
    assert ranges.running_totals(df, ["g"], ["s"], {"v": "total"}).count() == 0


def test_average_precision_and_auc_over_many_ranges(spark, small_ranges):
    rng = np.random.default_rng(4)
    rows = [(0.5, i, 1, float(rng.integers(0, 20)) / 20, int(rng.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "threshold double, image_id int, ordinal int, confidence double, tp int")
    truth = spark.range(180)
    ap = detection.average_precision(df, truth).first().ap
    ordered = sorted(rows, key=lambda r: (-r[3], r[1]))
    ctp = np.cumsum([r[4] for r in ordered])
    precision, recall = ctp / np.arange(1, 401), ctp / 180
    want = sum(max((p for p, q in zip(precision, recall) if q >= k / 100), default=0) for k in range(101)) / 101
    assert ap == pytest.approx(want)
    scores, y = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    pairs = [(a > b) + 0.5 * (a == b) for a in scores[y == 1] for b in scores[y == 0]]
    assert metrics.roc_auc(df.withColumnRenamed("confidence", "score").withColumnRenamed("tp", "gt"), []).first().roc_auc == pytest.approx(np.mean(pairs))
    assert detection.average_precision(df, truth.limit(0)).first().ap == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_is_exact_over_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 17)
    x = np.round(np.random.default_rng(1).normal(size=(120, 4)), 1)
    x[7] = x[8] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {(r.q, r["rank"]): r.id for r in neighbours.nearest(df.where("id % 10 = 7"), df, "id", "v", 5, metric, places=9).collect()}
    for q in range(7, 120, 10):
        d = ((x - x[q]) ** 2).sum(1) if metric == "euclidean" else -(x @ x[q]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        order = sorted((i for i in range(120) if i != q), key=lambda i: (round(d[i], 9), i))[:5]
        assert [got[q, k + 1] for k in range(5)] == order


def test_weighted_sample_descends_to_every_row(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(2000)], "id int, w double").repartition(3)
    one, deep = (sampling.weighted_sample(df, "id", "w", 500, rows_per_leaf=n) for n in (20_000, 1))
    assert {r.draw: r.id for r in one.collect()} == {r.draw: r.id for r in sampling.weighted_sample(df.repartition(7), "id", "w", 500).collect()}
    drawn = deep.collect()
    assert sorted(r.draw for r in drawn) == list(range(500)) and all(r.w > 0 for r in drawn)
    assert sampling.weighted_sample(df.limit(0), "id", "w", 5).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, None, "a", 2.0), (2, "x", None, -1.0), (3, "y", "b", 0.0)], "id int, target string, text string, v double")
    assert [r.id for r in filters.with_target(df, "target").collect()] == [2, 3]
    assert [r.id for r in filters.with_target(df, "target", "text").collect()] == [3]
    assert filters.feature_columns(df, "target", excluded=["id"]) == ["text", "v"] and filters.feature_columns(df, "target", ["v", "no"]) == ["v"]
    assert filters.columns_by_kind(df, ["id", "text", "v"]) == (["id", "v"], ["text"])
    assert filters.has_negative(df.select(F.array("v").alias("a")), "a") and not filters.has_negative(df.where("v >= 0").select(F.array("v").alias("a")), "a")
    boxes = spark.createDataFrame([(1, [(0.3,)]), (2, [(0.1,)]), (3, [])], "id int, boxes array<struct<confidence:double>>")
    assert [r.id for r in boxes.where(filters.has_detection(F.col("boxes"))).collect()] == [1]
    rows = spark.createDataFrame([("OK", "0.5", "b", True), ("OK", "N/A", "b", None), ("X", "0.7", "c", False)], "status string, f1 string, mode string, binary boolean")
    assert filters.ranked_rows(rows, "f1").count() == 1 and filters.of_mode(rows, "b").count() == 2 and filters.of_mode(rows, binary=True).count() == 1


def test_pair_strictly(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, pred int")
    b = spark.createDataFrame([(1, 1), (2, 1)], "id int, gt int")
    assert filters.pair_strictly(a, b, "id").count() == 2
    for other in (b.limit(1), b.union(b.limit(1)), b.limit(0)):
        with pytest.raises(ValueError):
            filters.pair_strictly(a, other, "id")


def test_one_vs_rest_auc_is_undefined_with_one_class(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.3, 1)], "label string, score double, gt int")
    assert metrics.one_vs_rest_auc(rows.where("label = 'a'"), []).first().roc_auc == 1.0
    assert metrics.one_vs_rest_auc(rows, []).first().roc_auc is None


def test_sweep_status_weights_labels_and_saved_models(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3) + 2 * (i % 5 == 0)], int(i % 5 == 0), int(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, z int")
    d = models.with_features(df, "v", "y").select("id", "features", "label", "y", "z")
    found, status = models.sweep(d, d, ["gaussian_nb", "multinomial_nb", "logistic_regression", "no_such_family"], "id", 3, 2, balance=True)
    assert status["gaussian_nb"] == status["logistic_regression"] == "OK" and status["multinomial_nb"].startswith("SKIPPED") and status["no_such_family"].startswith("FAILED")
    table = {r.model: r for r in models.sweep_table(found, status, [0, 1]).collect()}
    assert len(table) == 4 and table["no_such_family"].f1 is None and table["logistic_regression"].recall > 0.8
    plain = models.sweep(d, d, ["logistic_regression"], "id", 3, 2)[0]
    assert found.where("model = 'logistic_regression' and pred = 1").count() > plain.where("pred = 1").count()
    long = models.sweep_labels(d, d, ["y", "z"], "logistic_regression", "id", 3)
    assert long.count() == 240 and metrics.one_vs_rest_auc(long.drop("pred"), []).first().n_labels == 2
    fitted = models.estimator("logistic_regression").fit(d)
    models.save_model(fitted, f"file://{tmp_path}/m")
    again = models.load_model(f"file://{tmp_path}/m")
    assert again.transform(d).select("prediction").collect() == fitted.transform(d).select("prediction").collect()
    n, s, p = models.moments(df.select("y", "v"), "y", "v")[1]
    x = np.array([r[1] for r in rows if r[2] == 1])
    assert n == len(x) and np.allclose(s, x.sum(0)) and np.allclose(p, x.T @ x)


def test_multiclass_sweep_has_no_confusion(spark):
    rows = spark.createDataFrame([("m", 0, 0), ("m", 1, 2), ("m", 2, 2)], "model string, pred int, gt int")
    r = metrics.sweep_metrics(rows, [0, 1, 2], ["model"]).first()
    assert r.tp is None and r.fp_rate is None and r.accuracy == pytest.approx(2 / 3)


def test_missing_archive_warns(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert readers.read_embedding_archives(spark, f"{tmp_path}/*.npz").count() == 0


def test_label_files_hold_the_full_image_box(spark, tmp_path):
    writers.write_box_labels(writers.full_image_boxes(spark.createDataFrame([("a",), ("b",)], "image_id string")), f"{tmp_path}/labels")
    assert sorted(tuple(r) for r in spark.read.text(f"{tmp_path}/labels").select("image_id", "value").collect()) == [("a", "0 0.5 0.5 1.0 1.0"), ("b", "0 0.5 0.5 1.0 1.0")]


def test_a_bound_value_is_used_as_often_as_needed(spark):
    assert spark.range(3).select(once(F.col("id") + 1, lambda x: x * x).alias("y")).collect() == [(1,), (4,), (9,)]
