"""Work of a pass that follows the rows and the model, not the shuffle setting or the width of a plan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meridia.operators import detection, features, learners, lime, models, ranges


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def most_tasks(spark, run):
    """The largest stage of the jobs that ``run`` starts, in tasks."""
    spark.sparkContext.setJobGroup("most-tasks", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("most-tasks"))
    run()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in set(tracker.getJobIdsForGroup("most-tasks")) - before for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return max(i.numTasks for i in map(tracker.getStageInfo, stages) if i)


def test_a_pass_over_few_keys_starts_few_tasks(spark, many_partitions):
    rows = spark.range(1000).coalesce(2)
    found = {}
    work = lambda batches: {k: v for b in batches for k, v in ((0, np.array([float(b.num_rows)])), (7, b.column(0).to_numpy()[:0].astype(float)))}
    assert most_tasks(spark, lambda: found.update(learners.summed(rows, work))) <= 8
    assert found[0].sum() == 1000 and len(found[7]) == 0


def test_small_arrays_share_batches():
    cells = [(k, np.full(4, float(k))) for k in range(100_000)]
    made = list(learners.packed(iter(cells), lambda keys: [pa.array(keys, pa.int64())], ["key", "cells"]))
    assert len(made) < 10 and sum(b.num_rows for b in made) == 100_000
    assert [k for b in made for k in b.column(0).to_pylist()] == [k for k, _ in cells]
    assert np.frombuffer(made[-1].column(1)[-1].as_py()).tolist() == [99_999.0] * 4


def test_sweep_trains_on_as_many_partitions_as_its_bytes_call_for(spark, many_partitions, monkeypatch):
    seen, plain = [], models.estimator

    def estimator(*args):
        made = plain(*args)
        fit = made.fit
        made.fit = lambda d: seen.append(d.rdd.getNumPartitions()) or fit(d)
        return made

    monkeypatch.setattr(models, "estimator", estimator)
    rows = spark.range(200).select(F.col("id").alias("i"), (F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array(F.col("id") % 2 - F.rand(1), F.rand(2))).alias("features"))
    rows = rows.repartition(64, "i")
    out, status = models.sweep(rows.where("i < 150"), rows.where("i >= 150"), ["gaussian_nb"], "i", 2, 2)
    assert status == {"gaussian_nb": "OK"} and out.count() == 50
    assert seen and max(seen) < 64


def test_quartile_edges_are_exact_beyond_ten_thousand_rows(spark):
    rows = spark.range(0, 40_001, 1, 5).select(F.array(F.sqrt(F.pmod(F.xxhash64("id"), F.lit(10**9))), F.when(F.col("id") % 7 > 0, F.hash("id").cast("double")), F.lit(float("nan"))).alias("v"))
    values = [np.array([r.v[i] for r in rows.collect()], float) for i in range(3)]
    edges = lime.quartile_edges(rows, "v")
    for i in (0, 1):
        x = np.sort(values[i][~np.isnan(values[i])])
        assert edges[i].tolist() == [x[0], *[x[-(-len(x) * q // 4) - 1] for q in (1, 2, 3)], x[-1]]
    assert edges[2].tolist() == [0.0] * 5
    assert lime.quartile_edges(rows.limit(0), "v").shape == (0, 5)


def test_running_totals_deal_ranges_by_spark_and_not_by_literals_in_the_plan(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 20)
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("s"), "id", F.lit(1).cast("long").alias("v"))
    found = ranges.running_totals(df, ["g"], ["s", "id"], {"v": "k"})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "filter(" not in plan.lower().replace("filter (", "")
    for g in range(3):
        own = sorted((r.s, r.id, r.k) for r in found.where(F.col("g") == g).collect())
        assert [k for *_, k in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_curves_by_group_over_many_ranges_equal_plain_counts(spark, monkeypatch, most):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(ranges, "SMALL", most)
    rng = np.random.default_rng(3)
    boxes = [(i, j, [None, float("nan"), *rng.random(8).round(1).tolist()][int(rng.integers(10))], 0.0, 0.0, float(rng.integers(5, 11)), 1.0) for i in range(120) for j in range(1, 1 + int(rng.integers(5)))]
    found = spark.createDataFrame(boxes, "image_id long, ordinal int, confidence double, x1 double, y1 double, x2 double, y2 double")
    truth = spark.createDataFrame([(i, 0, 0.0, 0.0, 10.0, 1.0) for i in range(0, 120, 2)], "image_id long, ordinal int, x1 double, y1 double, x2 double, y2 double")
    matches = detection.match_single(found, truth, [0.5, 0.8])
    got = {(r.image_id, r.ordinal, r.threshold): r.tp for r in matches.collect()}
    order = lambda b: (b[2] is None, not (b[2] is None or b[2] != b[2]), -(b[2] or 0) if b[2] == b[2] else 0, b[1])
    for i in range(120):
        own = sorted((b for b in boxes if b[0] == i), key=order)
        for t in (0.5, 0.8):
            hit = next((b[1] for b in own if i % 2 == 0 and b[5] / 10 >= t), None)
            assert [got[i, b[1], t] for b in own] == [int(b[1] == hit) for b in own]
    groups = truth.select("image_id", (F.col("image_id") % 3).alias("g"))
    for r in detection.metrics_by_group(matches, truth, groups, "g").collect():
        own = [v for (i, _, t), v in got.items() if i % 2 == 0 and i % 3 == r.g and t == r.threshold]
        assert (r.tp, r.fp, r.fn) == (sum(own), len(own) - sum(own), 20 - sum(own))


def test_term_counts_are_dealt_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(features, "WORDS_PER_TASK", 50)
    docs = spark.range(40).select((F.col("id") % 39).alias("i"), F.transform(F.sequence(F.lit(1), F.col("id") % 9 + 5), lambda w: F.concat(F.lit("w"), (w * F.col("id")) % 7)).alias("w"))
    found = features.tfidf(docs, F.col("i") % 5 != 0, "i", "w", 5)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    counts, train = {}, {r.i for r in docs.collect() if r.i % 5}
    for r in docs.collect():
        counts.setdefault(r.i, []).extend(r.w)
    total = {}
    for i in train:
        for w in counts[i]:
            total[w] = total.get(w, 0) + 1
    n = docs.where("i % 5 <> 0").count()
    idf = {w: np.log((1 + n) / (1 + sum(w in counts[i] for i in train))) + 1 for w in sorted(total, key=lambda w: (-total[w], w))[:5]}
    want = {(i, w): ws.count(w) * v for i, ws in counts.items() for w, v in idf.items() if w in ws}
    got = {(r.i, r.word): r.weight for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[i, w], v / np.sqrt(sum(x * x for (j, _), x in want.items() if j == i))) for (i, w), v in want.items())


def test_radial_svc_predicts_all_classes_in_one_python_function(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2)) + 6 * np.eye(3)[np.arange(150) % 3][:, :2]
    rows = spark.createDataFrame([(float(i % 3), v.tolist()) for i, v in enumerate(x)], "label double, v array<double>").withColumn("features", array_to_vector("v"))
    model = learners.RadialSVC(landmarks=16, maxIter=10).fit(rows)
    found = model.transform(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    raw = np.stack([model.kernel.features(x) @ m.coefficients.toArray() + m.intercept for m in model.machine.models], 1)
    assert [r.prediction for r in found.select("v", "prediction").collect()] == raw.argmax(1).astype(float).tolist()
