"""Learned models and their explanations over the embeddings and texts."""

from __future__ import annotations

from pyspark.ml import classification as mc
from pyspark.ml import feature as mf
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import features, forests, learners, lime, metrics, models
from .registry import query, rounded, table
from .vectors import DIM

#: Width of the pooled vectors that local explanations perturb, and samples a row.
POOLED, SAMPLES = 8, 200

SPLIT = """h AS (SELECT vec_id, (label < 5)::INT AS y, md5('4711:' || vec_id) AS h FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, vec_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM h),
s AS (SELECT vec_id, y, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r)"""


def _split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return features.stratified_split(models.with_features(e, "embedding", "y").select("vec_id", "features", "label", "embedding"), "vec_id", "label")


def _classes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return features.stratified_split(models.with_features(e, "embedding", "label").select("vec_id", "features", "label"), "vec_id", "label")


def _tested(model, rows):
    found = model.transform(rows).select(F.col("prediction").cast("int").alias("pred"), F.col("label").cast("int").alias("gt"))
    return rounded(metrics.classification_metrics(found, list(range(10)), []))


@query()
def multiclass_boosting(spark, sf_dir):
    """Ten classes, softmax boosting on binned histograms; metrics on the test rows."""
    d = _classes(spark, sf_dir)
    return _tested(learners.multiclass_boosting(rounds=10, depth=4).fit(d.where("split = 'train'")), d.where("split = 'test'"))


@query()
def extra_trees(spark, sf_dir):
    d = _classes(spark, sf_dir)
    return _tested(learners.extra_trees().fit(d.where("split = 'train'")), d.where("split = 'test'"))


@query()
def ada_boost(spark, sf_dir):
    d = _classes(spark, sf_dir)
    return _tested(learners.ada_boost().fit(d.where("split = 'train'")), d.where("split = 'test'"))


@query()
def radial_svc(spark, sf_dir):
    d = _classes(spark, sf_dir)
    return _tested(learners.RadialSVC().fit(d.where("split = 'train'")), d.where("split = 'test'"))


@query()
def online_learners(spark, sf_dir):
    """Perceptron and passive-aggressive, averaged; a row each."""
    d = _classes(spark, sf_dir)
    rows = [_tested(learners.online(rule).fit(d.where("split = 'train'")), d.where("split = 'test'")).withColumn("rule", F.lit(rule)) for rule in ("perceptron", "passive_aggressive")]
    return rows[0].unionByName(rows[1])


# On every value of one feature, the best first stump and its vote: SAMME's first round, with classes weighed alike.
FIRST = """k AS (SELECT (label < 5)::INT AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
v AS (SELECT f, x, sum(y)::DOUBLE AS a, count(*)::DOUBLE AS n FROM k GROUP BY f, x),
c AS (SELECT f, x, sum(a) OVER w AS a, sum(n) OVER w AS n, sum(a) OVER (PARTITION BY f) AS ta, sum(n) OVER (PARTITION BY f) AS tn FROM v WINDOW w AS (PARTITION BY f ORDER BY x)),
q AS (SELECT *, tn - (a * a + (n - a) * (n - a)) / n - ((ta - a) * (ta - a) + (tn - n - ta + a) * (tn - n - ta + a)) / (tn - n) AS gini FROM c WHERE n < tn),
b AS (SELECT *, 1 - (greatest(a, n - a) + greatest(ta - a, tn - n - ta + a)) / tn AS error FROM q ORDER BY round(gini, 9), f, x LIMIT 1)"""


@query(f"WITH {FIRST} SELECT f::INT AS feature, round(x, 6) AS threshold, (2 * a > n)::INT AS left_class, (2 * (ta - a) > tn - n)::INT AS right_class, round(ln((1 - error) / error), 6) AS vote FROM b")
def first_stump(spark, sf_dir):
    """The first round of AdaBoost over all rows, every value a cut."""
    e = models.with_features(table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")), "embedding", "y")
    stumps = learners.ada_boost(rounds=1, bins=10_000).fit(e).predictor.stumps
    # One row for each stump of the model; a model, not data, is what the driver holds.
    found = spark.createDataFrame([(f, t, a, b, v) for f, t, a, b, v in stumps], "feature int, threshold double, left_class int, right_class int, vote double")
    return rounded(found)


def _forest(spark, sf_dir, d):
    return mc.RandomForestClassifier(numTrees=20, maxDepth=6, bootstrap=False, seed=42).fit(d.where("split = 'train'"))


def _shap(spark, sf_dir):
    d = _split(spark, sf_dir)
    return forests.tree_shap(d, forests.forest_tables(_forest(spark, sf_dir, d)), "vec_id", "embedding", DIM)


@query()
def tree_shap(spark, sf_dir):
    """Shapley values of every row, output and feature of a random forest."""
    return _shap(spark, sf_dir).select("vec_id", "output", "base", "prediction", F.transform("shap", lambda v: F.round(v, 9)).alias("shap"))


@query(f"""WITH {SPLIT}, b AS (SELECT avg(y) AS share FROM s WHERE split = 'train'), o AS (SELECT unnest([0, 1]) AS output)
SELECT vec_id, output::INT AS output, round(CASE WHEN output = 1 THEN share ELSE 1 - share END, 6) AS base, 0.0::DOUBLE AS gap, 64 AS n FROM s, b, o""")
def tree_shap_sums(spark, sf_dir):
    """Without bootstrap a forest's mean is the training share; every row's values sum to its prediction less that."""
    total = F.aggregate("shap", F.lit(0.0), lambda s, v: s + v)
    gap = F.abs(F.round(total - (F.col("prediction") - F.col("base")), 6))
    return _shap(spark, sf_dir).select("vec_id", "output", F.round("base", 6).alias("base"), gap.alias("gap"), F.size("shap").alias("n"))


@query()
def shap_importance(spark, sf_dir):
    """Mean size of a feature's Shapley value over all rows, for the second class."""
    long = _shap(spark, sf_dir).where("output = 1").select(F.posexplode("shap").alias("feature", "value"))
    return rounded(long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"), F.avg("value").alias("mean_value")))


def _pooled(spark, sf_dir):
    """Vectors of eight means over eight neighbouring entries."""
    means = F.transform(F.sequence(F.lit(0), F.lit(POOLED - 1)), lambda i: F.aggregate(F.slice("embedding", i * (DIM // POOLED) + 1, DIM // POOLED), F.lit(0.0), lambda s, v: s + v.cast("double")) / (DIM // POOLED))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(means, lambda m: F.round(m, 9)).alias("v"), (F.col("label") < 5).cast("double").alias("label"))


def _explained(spark, sf_dir):
    rows = _pooled(spark, sf_dir)
    model = mc.LogisticRegression(maxIter=50).fit(rows.withColumn("features", array_to_vector("v")))

    def predict(samples):
        return model.transform(samples.withColumn("features", array_to_vector("vector"))).withColumn("score", vector_to_array("probability")[1])

    return lime.explain_rows(rows, rows, predict, "vec_id", "v", samples=SAMPLES)


@query(f"""WITH e AS (SELECT vec_id, i, round(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x : x::DOUBLE)) / 8, 9) AS x FROM embeddings, (SELECT unnest(range({POOLED})) AS i)),
q AS (SELECT i, quantile_disc(x, 0.25) AS a, quantile_disc(x, 0.5) AS b, quantile_disc(x, 0.75) AS c FROM e GROUP BY i),
o AS (SELECT vec_id, i, (x > a)::INT + (x > b)::INT + (x > c)::INT AS own FROM e JOIN q USING (i)),
f AS (SELECT vec_id, s, list((CASE WHEN s = 0 OR least(3, floor(('0x' || substr(md5('42:' || vec_id || ':' || s || ':' || i), 1, 8))::BIGINT / 4294967296.0 * 4)) = own THEN 1 ELSE 0 END) ORDER BY i) AS z
      FROM o, (SELECT unnest(range({SAMPLES})) AS s) GROUP BY vec_id, s),
w AS (SELECT vec_id, list_append(z, 1) AS z, sqrt(exp(-({POOLED} - list_sum(z)) / ((0.75 * sqrt({POOLED})) ** 2))) AS w FROM f),
c AS (SELECT unnest(range({POOLED} + 1)) AS row)
SELECT vec_id, row::INT AS row, col::INT AS col, round(sum(w * z[row + 1] * z[col + 1]), 6) AS cell FROM w, c, (SELECT row AS col FROM c) GROUP BY ALL""")
def lime_matrices(spark, sf_dir):
    """Cells of the weighted normal matrix that a row's local model is solved from."""
    cells = _explained(spark, sf_dir).select("vec_id", F.posexplode("normal").alias("at", "cell"))
    n = POOLED + 1
    return rounded(cells.select("vec_id", F.floor(F.col("at") / n).cast("int").alias("row"), (F.col("at") % n).alias("col"), "cell"))


@query()
def lime_rows(spark, sf_dir):
    """Local linear weights of every row's quartile flags, with the weighted fit."""
    found = _explained(spark, sf_dir)
    return rounded(found.select("vec_id", F.posexplode("weights").alias("feature", "weight"), "intercept", "fit"))


@query()
def lime_texts(spark, sf_dir):
    """Words of every benchmark text that move a text model's score, with their local weight."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text is not null and quality is not null")
    stages = [mf.Tokenizer(inputCol="text", outputCol="tokens"), mf.HashingTF(inputCol="tokens", outputCol="features", numFeatures=4096), mc.LogisticRegression(maxIter=20, regParam=0.01)]
    model = Pipeline(stages=stages).fit(docs.select("text", F.col("quality").cast("double").alias("label")))

    def predict(samples):
        return model.transform(samples).withColumn("score", vector_to_array("probability")[1])

    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = lime.explain_texts(items, predict, "item_id", "text", samples=SAMPLES)
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    named = found.join(items, "item_id").select("item_id", F.posexplode("weights").alias("place", "weight"), words.alias("words"))
    return rounded(named.select("item_id", "place", F.get("words", F.col("place")).alias("word"), "weight"))
