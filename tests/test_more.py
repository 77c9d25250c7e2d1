"""Augmentation, parameter search, folder scans and small expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.operators import features, images, models
from meridia.sources import readers


def test_augment_depends_on_seed_and_id_alone(spark):
    x = np.random.default_rng(1).integers(0, 256, (6, 7, 3)).astype(np.uint8)
    df = spark.createDataFrame([(i, bytearray(x.tobytes()), 6, 7) for i in range(12)], "id int, pixels binary, height int, width int")
    a, b = ({r.id: bytes(r.pixels) for r in images.augment(d, "id").collect()} for d in (df, df.repartition(5)))
    assert a == b and len(set(a.values())) > 6 and all(len(p) == x.size for p in a.values())
    assert (images.turned(x, 0.0, 1.0) == x).all()
    with pytest.raises(ValueError):
        images.augment(df, "id", seed=-1)


def test_edges_of_a_square():
    x = np.zeros((20, 20, 3), np.uint8)
    x[6:14, 6:14] = 255
    edges = images.canny_edges(x)[:, :, 0] > 0
    assert edges.any() and not edges[:3].any() and not edges[9:11, 9:11].any()


def test_parameter_search(spark):
    rows = [(i, [float(i % 2), float(i % 7)], i % 2) for i in range(60)]
    train = models.with_features(spark.createDataFrame(rows, "id int, v array<double>, y int"), "v", "y")
    best, tried = models.search(train, "multinomial_nb", "id", folds=2)
    assert len(tried) == 2 and best in [t[0] for t in tried]
    assert models.search(train, "multinomial_nb", "id", how="none", folds=2)[0] == {}
    assert len(models.search(train, "multinomial_nb", "id", how="random", n_iter=1, folds=2)[1]) == 1
    with pytest.raises(ValueError):
        models.search(train, "multinomial_nb", "id", how="odd")


def test_folders_and_manifests(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = readers.read_image_folder(spark, str(tmp_path), "s").orderBy("image_id").collect()
    assert [(r.image_id, r.path.rsplit("/", 1)[1]) for r in got] == [("s_0", "a.jpg"), ("s_1", "b.PNG")]
    files = readers.read_class_folders(spark, str(tmp_path))
    assert readers.same_manifest(files, files) and not readers.same_manifest(files, files.limit(1))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        readers.read_image_folder(spark, f"{tmp_path}/none", "s")


def test_evaluation_row_and_expressions(spark):
    table = spark.createDataFrame([(" A ", 0.1, 0), ("A", 0.2, 1)], "Model string, F1 double, ordinal int")
    assert readers.evaluation_row(table, "A", "ordinal").first().F1 == 0.1
    steps = spark.createDataFrame([(s,) for s in (0, 5, 10, 55, 100, 120)], "s int").select(features.warmup_cosine(F.col("s"), 10, 100).alias("f"))
    assert [round(r.f, 6) for r in steps.collect()] == [0.0, 0.5, 1.0, 0.5, 0.0, 0.0]
    words = spark.createDataFrame([([("a", 0.9), ("b", 0.1), ("c", 0.3)],)], "w array<struct<text:string,confidence:double>>")
    assert words.select(tx.confident_text(F.col("w")).alias("t")).first().t == "a c"
