"""Metrics on hand-worked cases and against a plain scorer."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.operators import features, metrics, ranking, uncertainty
from meridia.operators.profiling import active_count_histogram, cooccurrence

LABELS = ("shaming", "stereotype", "objectification", "violence")
PREDS = [(1, 0, 1, 0), (0, 1, 1, 0), (1, 1, 0, 1), (0, 0, 0, 0)]
TRUTH = [(1, 0, 1, 0), (1, 1, 0, 0), (0, 1, 1, 1), (0, 0, 0, 0)]


def long(spark, preds, truth):
    rows = [(i, x, p[k], g[k]) for i, (p, g) in enumerate(zip(preds, truth)) for k, x in enumerate(LABELS)]
    return spark.createDataFrame(rows, "id int, label string, pred int, gt int")


def counts(spark, *cells):
    return spark.createDataFrame([(*c, sum(c)) for c in cells], "tp long, fp long, fn long, tn long, n long")


def f1(tp, fp, fn):
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def test_score_b_worked_example(spark):
    got = metrics.multilabel_metrics(long(spark, PREDS, TRUTH), "id", []).first()
    assert got.score_b == pytest.approx(5 / 7) and got.macro_f1 == pytest.approx(0.75)
    assert got.exact_match == 0.5 and got.n == 4
    assert metrics.score_b(long(spark, PREDS, TRUTH), []).first().score_b == pytest.approx(5 / 7)


@pytest.mark.parametrize("preds, truth, want", [(TRUTH, TRUTH, 1.0), ([(0,) * 4] * 4, [(1, 1, 1, 1)] * 2 + [(0,) * 4] * 2, 1 / 3), ([(0,) * 4], [(0,) * 4], 0.0)])
def test_score_b_extremes(spark, preds, truth, want):
    assert metrics.score_b(long(spark, preds, truth), []).first().score_b == pytest.approx(want)


def test_no_rows_score_zero(spark):
    empty = long(spark, PREDS, TRUTH).limit(0)
    assert metrics.score_b(empty, []).first().score_b == 0.0


def test_published_counts(spark):
    a, b = metrics.per_label(counts(spark, (447, 246, 53, 254), (8, 4, 2, 6))).orderBy("n").collect()[::-1]
    assert (round(a.f1_positive, 6), round(a.f1_macro, 6)) == (0.749371, 0.689432)
    assert round(b.f1_macro, 6) == 0.69697
    rows = [(1, 1)] * 8 + [(1, 0)] * 4 + [(0, 1)] * 2 + [(0, 0)] * 6
    v = metrics.f1_variants(spark.createDataFrame(rows, "pred int, gt int"), []).first()
    assert round(v.f1_of_macro_pr, 6) == 0.704142 and v.f1_macro < v.f1_of_macro_pr


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from([None, 0, 1]), st.integers(0, 1)), min_size=1, max_size=30))
def test_binary_metrics_are_a_plain_scorers(spark, rows):
    got = metrics.per_label(metrics.confusion(spark.createDataFrame(rows, "pred int, gt int"), [])).first()
    tp = sum(p == 1 and g == 1 for p, g in rows)
    fp = sum(p == 1 and g == 0 for p, g in rows)
    fn = sum(p != 1 and g == 1 for p, g in rows)
    tn = len(rows) - tp - fp - fn
    assert (got.tp, got.fp, got.fn, got.tn) == (tp, fp, fn, tn)
    assert got.f1_macro == pytest.approx((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2)


def test_a_null_answer_is_wrong_and_macro_goes_over_the_given_list(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), ("b", "b"), ("a", "b")], "pred string, gt string")
    got = metrics.classification_metrics(df, ["a", "b", "never"], []).first()
    assert got.accuracy == 0.5 and got.f1_macro == pytest.approx((f1(1, 1, 1) + f1(1, 0, 1) + 0) / 3)
    none = metrics.parsed_only_metrics(df.withColumn("pred", F.lit(None).cast("string")), ["a", "b"], []).first()
    assert none.status == "NONE PARSED" and none.f1_macro == 0.0


@pytest.mark.parametrize("scores, want", [([0.9] * 3 + [0.1] * 3, 0.11), ([0.35, 0.32, 0.30, 0.05, 0.02, 0.01], 0.06), ([0.85, 0.82, 0.80, 0.55, 0.52, 0.50], 0.56)])
def test_lowest_best_threshold(spark, scores, want):
    df = spark.createDataFrame(list(zip(scores, [1, 1, 1, 0, 0, 0])), "score double, gt int")
    best = metrics.best_threshold(metrics.threshold_scan(df, []), [])
    assert best.first().threshold == pytest.approx(want) and best.first().f1_macro == 1.0
    assert metrics.apply_threshold(df, best, []).where("pred <> gt").isEmpty()


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("x", 0.1, 0), ("x", 0.4, 0), ("x", 0.4, 1), ("x", 0.8, 1), ("y", 0.5, 1)], "m string, score double, gt int")
    got = {r.m: r.roc_auc for r in metrics.roc_auc(df, ["m"]).collect()}
    assert got == {"x": pytest.approx(0.875), "y": None}


def test_weights(spark):
    rows = [(int(i < 14), 0, 1) for i in range(100)]
    got = {r.label: r.pos_weight for r in features.positive_weights(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"]).collect()}
    assert got == {"a": pytest.approx(86 / 14), "b": 1.0, "c": 0.0}
    df = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0)], " int, ".join(LABELS) + " int")
    weight = features.sample_weight(["shaming", "violence"], ["stereotype", "objectification"])
    assert [r.w for r in df.select(weight.alias("w")).collect()] == [1, 4, 2, 5]


def test_ranking_puts_nan_last_and_keeps_order_on_ties(spark):
    df = spark.createDataFrame([("a", 0.82, 1), ("b", 0.89, 2), ("c", float("nan"), 3), ("d", 0.89, 4), ("e", None, 5)], "model string, f1 double, ordinal int")
    assert [r.model for r in ranking.leaderboard(df, "f1", "ordinal").orderBy("rank").collect()] == ["b", "d", "a", "c", "e"]
    assert ranking.best_row(df, "f1", "ordinal").first().model == "b"


def test_gate_zeroes_what_the_first_stage_refuses(spark):
    first = spark.createDataFrame([("1", 1, 0), ("1", 0, 1), ("2", 1, 2), ("3", None, 3)], "image_id string, pred int, ordinal int")
    second = spark.createDataFrame([(str(i), [1, 0, 1, 1]) for i in range(1, 5)], "image_id string, pred array<int>")
    got = {r.image_id: (r.gated, r.pred) for r in ranking.gate(ranking.last_per_id(first, "image_id", "ordinal"), second).collect()}
    assert got == {"1": (True, [0] * 4), "2": (False, [1, 0, 1, 1]), "3": (True, [0] * 4)}


def test_uncertainty(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [1.0, 0.0], 0), (3, [0.9, 0.1], 1), (4, [0.7, 0.2, 0.1], 0)], "id int, probs array<double>, y int")
    got = {r.id: r for r in uncertainty.uncertainty_rows(df, "probs", "y").collect()}
    assert [round(got[i].entropy, 6) for i in (1, 2, 3, 4)] == [1.0, 0.0, 0.468996, 1.15678]
    assert [round(got[i].margin, 6) for i in (1, 2, 3, 4)] == [0.0, 1.0, 0.8, 0.5]
    assert [got[i].correct for i in (1, 2, 3, 4)] == [1, 1, 0, 1]


def test_profiles_keep_empty_bins(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "a int, b int")
    assert {r.active: r.n for r in active_count_histogram(df, ["a", "b"]).collect()} == {0: 1, 1: 1, 2: 1}
    got = {(r.a, r.b): (r.both, r.given_a) for r in cooccurrence(df, ["a", "b"]).collect()}
    assert got[("a", "b")] == (1, 0.5) and got[("b", "a")] == (1, 1.0)
