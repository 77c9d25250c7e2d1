"""Sources, sinks, features, sampling, detection, vectors, images and the streaming extension."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import schemas
from meridia.functions import vectors as vx
from meridia.operators import detection, features, images, inference, modality, sampling
from meridia.sources import readers, writers
from meridia.streaming.confusion import windowed_confusion


def test_split_scan(spark, tmp_path):
    (tmp_path / "train.tsv").write_text('file_name\tlabel\tshaming\ttext\na/1.jpg\t1\t0\t"two\nlines"\nb.c.png\t\t1\t\n', encoding="utf-8")
    (tmp_path / "test.tsv").write_text("file_name\tlabel\n9.jpg\t0\n", encoding="utf-8")
    rows = {r.image_id: r for r in readers.read_split(spark, str(tmp_path), "train").collect()}
    assert (rows["1"].text, rows["1"].label) == ("two\nlines", 1) and (rows["b.c"].label, rows["b.c"].shaming, rows["b.c"].text) == (0, 1, "")
    both = readers.read_splits(spark, str(tmp_path), "train, test", limit=2)
    assert {r.split for r in both.collect()} == {"train"} and "split_no" not in both.columns
    with pytest.raises(ValueError):
        readers.read_split(spark, str(tmp_path), "dev")
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.doc")


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(schemas.SchemaError, match="b, c"):
        schemas.require(df, ["a", "b", "c"])
    with pytest.raises(schemas.SchemaError, match="a is int"):
        schemas.require(df, schemas.struct("a string"))


def test_embedding_archive(spark, tmp_path):
    n = 3
    np.savez(
        tmp_path / "x.npz", image_ids=np.array(["a", "b", "c"]), image_embeddings=np.ones((n, 2), np.float32), text_embeddings=np.zeros((n, 2), np.float32),
        labels=np.array([0, 1, 0], np.int32), subtask_labels=np.zeros((n, 4), np.int32), raw_texts=np.array(["x", "y", "z"]),
    )
    rows = readers.read_embedding_archives(spark, f"{tmp_path}/*.npz").orderBy("image_id").collect()
    assert [r.image_id for r in rows] == ["a", "b", "c"] and rows[1].label == 1 and rows[0].img_emb == [1.0, 1.0] and rows[2].subtask == [0] * 4


def test_results_take_the_row_without_a_filter(spark, tmp_path):
    rows = [{"model": "m", "filter": f, "split": "test", "task": "a", "macro_f1": v} for f, v in (("blur", 0.3), ("none", 0.62), ("grayscale", 0.4))]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "s.json").write_text(json.dumps({"model": "n", "macro_f1": 0.5}))
    got = {r.model: (r.macro_f1, r.score_b) for r in readers.read_results(spark, str(tmp_path)).collect()}
    assert got == {"m": (0.62, None), "n": (0.5, None)}


def test_predictions_long_and_wide(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Actual,A,B\n1,1.0,0\n0,0,\n,1,1\n')
    long = readers.read_predictions(spark, f"{tmp_path}/p.csv")
    assert sorted((r.model, r.actual, r.pred) for r in long.collect()) == [("A", 0, 0), ("A", 1, 1), ("B", 1, 0)]
    writers.write_wide_predictions(long, f"{tmp_path}/wide", ["A", "B"])
    assert sorted(spark.read.csv(f"{tmp_path}/wide", header=True).columns) == ["A", "Actual", "B"]


def test_report_sinks(spark, tmp_path):
    board = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.9)], "model string, f1 double")
    writers.write_ranked(board, f"{tmp_path}/r", "f1")
    assert [r.model for r in spark.read.csv(f"{tmp_path}/r", header=True).collect()] == ["c", "a", "b"]
    assert writers.markdown_table(board).splitlines()[3] == "| b | N/A |"
    payload = writers.metrics_payload(board, "binary", "test", "provided", "c").first()
    assert payload.best_model == "c" and len(payload.models) == 3


def mixed(spark):
    rows = [(i, None if 5 <= i < 10 else float(i), None if 15 <= i < 20 else "xyx"[i % 3], int(i % 10 < 3)) for i in range(100)]
    return spark.createDataFrame(rows, "id int, num double, cat string, y int")


def test_preparation_fits_on_training_rows(spark):
    df = features.stratified_split(mixed(spark), "id", "y")
    by = {(r.y, r.split): r["count"] for r in df.groupBy("y", "split").count().collect()}
    assert by == {(0, "test"): 14, (0, "train"): 56, (1, "test"): 6, (1, "train"): 24}
    again = features.stratified_split(mixed(spark).repartition(7), "id", "y")
    assert df.select("id", "split").exceptAll(again.select("id", "split")).isEmpty()
    train = df.where("split = 'train'")
    full = features.impute_categorical(features.impute_numeric(df, train, ["num"], "mean"), train, ["cat"], "mean")
    assert full.where("num is null or cat is null").isEmpty()
    scaled = features.scale(full, full, ["num"], "standard").agg(F.avg("num").alias("m"), F.stddev_pop("num").alias("s")).first()
    assert (round(scaled.m, 9), round(scaled.s, 9)) == (0, 1)
    hot = features.one_hot(features.ordinal_encode(spark.createDataFrame([("y",), ("new",), (None,)], "cat string"), train, "cat"), train, "cat")
    assert [(r.cat_level, r.cat_hot) for r in hot.orderBy(F.desc("cat_level"), "cat").collect()] == [(1, [0.0, 1.0]), (-1, [0.0, 0.0]), (-1, [0.0, 0.0])]
    with pytest.raises(ValueError):
        features.scale(df, train, ["num"], "odd")


@pytest.mark.parametrize("cats, n, want", [("aabbccdd" * 5, 10, [2, 2, 3, 3]), ("abc" * 5, 5, [1, 2, 2]), ("a", 5, [5]), ("", 5, [])])
def test_balanced_sample(spark, cats, n, want):
    df = spark.createDataFrame(list(enumerate(cats)), "id int, cat string")
    got = sampling.balanced_sample(df, "id", "cat", n)
    assert sorted(r["count"] for r in got.groupBy("cat").count().collect()) == want
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, "id", "cat", n, seed=-1)


def test_balanced_sample_takes_null_as_a_category(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None) for i in range(60)], "id int, cat string")
    got = {r.cat: r["count"] for r in sampling.balanced_sample(df, "id", "cat", 10).groupBy("cat").count().collect()}
    assert got == {None: 4, "a": 3, "b": 3}


def test_weighted_sample_draws_all_and_favours_weight(spark):
    df = spark.createDataFrame([(i, 9.0 if i == 0 else 1.0) for i in range(10)], "id int, w double")
    got = sampling.weighted_sample(df, "id", "w", 200)
    assert got.select("draw").distinct().count() == 200 == got.count() and got.where("id = 0").count() > 60


def test_smote_stays_between_neighbours(spark):
    df = spark.createDataFrame([(str(i), [float(i), 1.0], int(i < 3)) for i in range(10)], "id string, v array<float>, y int")
    made = features.smote(df, "id", "v", "y", 1, per_row=2).collect()
    assert len(made) == 6 and all(0 <= r.v[0] <= 2 and r.v[1] == 1 and r.y == 1 for r in made)


BOX = "image_id string, x1 double, y1 double, x2 double, y2 double, ordinal int"


def test_detection_worked_example(spark):
    truth = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 10.0, 0), ("B", 0.0, 0.0, 10.0, 10.0, 0)], BOX)
    found = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 10.0, 0, 0.9), ("A", 0.0, 0.0, 10.0, 10.0, 1, 0.8), ("B", 0.0, 0.0, 10.0, 6.0, 0, 0.7)], BOX + ", confidence double")
    for match in (detection.match_single, detection.match_greedy):
        m = match(found, truth, [0.5, 0.75])
        c = {r.threshold: (r.tp, r.fp, r.fn) for r in detection.detection_counts(m, truth).collect()}
        assert c == {0.5: (2, 1, 0), 0.75: (1, 2, 1)}
        ap = {r.threshold: round(r.ap, 6) for r in detection.average_precision(m, truth).collect()}
        assert ap == {0.5: 0.834983, 0.75: 0.50495}
    assert {r.ap for r in detection.average_precision(detection.match_single(found, truth.limit(0), [0.5]), truth.limit(0)).collect()} == {0.0}


def test_greedy_takes_the_first_free_box_it_reaches(spark):
    truth = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 10.0, 0), ("A", 0.0, 0.0, 10.0, 8.0, 1)], BOX)
    found = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 8.0, 0, 0.9), ("A", 0.0, 0.0, 10.0, 10.0, 1, 0.8)], BOX + ", confidence double")
    assert [r.tp for r in detection.match_greedy(found, truth, [0.5]).collect()] == [1, 1]


def test_iou(spark):
    rows = [((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 10, 10), (0, 0, 10, 6), 0.6), ((0, 0, 1, 1), (2, 2, 3, 3), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)]
    names = [f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([tuple(map(float, a + b)) for a, b, _ in rows], ", ".join(f"{n} double" for n in names))
    assert [r.o for r in df.select(detection.iou("a_", "b_").alias("o")).collect()] == pytest.approx([w for *_, w in rows])


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = df.select(vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.softmax(F.col("b")).alias("s"), vx.fuse(F.col("a"), F.col("b"), "mult").alias("m")).collect()
    assert a.c == pytest.approx(0.96) and b.c == 0.0 and sum(a.s) == pytest.approx(1) and a.m == [12.0, 12.0]
    with pytest.raises(ValueError):
        vx.fuse(F.col("a"), F.col("b"), "sum")


def test_modality_and_neighbours(spark):
    df = spark.createDataFrame([("m", [3.0, -1.0, 1.0]), ("z", [0.0, 0.0, 0.0])], "model string, v array<double>")
    got = {r.model: (r.image_pct, r.text_pct) for r in modality.modality_importance(df, "v", 2, ["model"], empty_share=50.0).collect()}
    assert got == {"m": (80.0, 20.0), "z": (50.0, 50.0)}
    points = spark.createDataFrame([(i, [float(i)], int(i > 4)) for i in range(10)], "id int, v array<float>, y int")
    near = {r.id: r.pred for r in modality.knn_classify(points.where("id in (0, 9)"), points, "id", "v", "y", 3).collect()}
    assert near == {0: 0, 9: 1}


def test_inferencer_isolates_failures(spark):
    df = spark.createDataFrame([(1, "You FOOL"), (2, "hello"), (3, None)], "id int, text string")
    assert {r.id: r.prediction for r in inference.infer(df, inference.KeywordInferencer(["fool"]), "id").collect()} == {1: "yes", 2: "no", 3: "no"}
    broken = inference.infer(df.drop("text"), inference.KeywordInferencer(["fool"]), "id").collect()
    assert all(r.prediction is None and r.failed and not r.refusal for r in broken) and len(broken) == 3


@pytest.mark.parametrize("name", sorted(images.FILTERS))
def test_filters_keep_bytes(spark, name):
    x = np.random.default_rng(0).integers(0, 256, (24, 30, 3)).astype(np.uint8)
    y = images.FILTERS[name](x)
    assert y.dtype == np.uint8 and y.shape == x.shape
    flat = images.FILTERS[name](np.full((24, 30, 3), 90, np.uint8))
    assert len(np.unique(flat.reshape(-1, 3), axis=0)) == 1
    with pytest.raises(ValueError):
        images.apply_filter(spark.createDataFrame([(b"", 0, 0)], "pixels binary, height int, width int"), "odd")


def test_filter_over_a_column(spark):
    x = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    df = spark.createDataFrame([(bytearray(x.tobytes()), 4, 5)], "pixels binary, height int, width int")
    out = np.frombuffer(images.apply_filter(df, "gamma_correction").first().pixels, np.uint8)
    assert (out >= x.ravel()).all()


def test_streamed_windows_equal_the_table_at_rest(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 2, int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, pred int, gt int").select(F.to_timestamp("t").alias("ts"), "pred", "gt")
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_confusion(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts")
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("windows").count() == 3 and spark.table("windows").exceptAll(windowed_confusion(df, "ts")).isEmpty()
