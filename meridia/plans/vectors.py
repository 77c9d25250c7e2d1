"""Embedding queries: similarity, zero-shot, neighbours, uncertainty, modality, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import features, metrics, modality, models, neighbours, uncertainty
from .registry import query, rounded, table

DIM, IMAGE = 64, 32

LONG = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id),
u AS (SELECT e.vec_id, label, dim, x / norm AS x FROM e JOIN n USING (vec_id)),
c0 AS (SELECT label, dim, avg(x) AS x FROM u GROUP BY label, dim), cn AS (SELECT label, sqrt(sum(x * x)) AS norm FROM c0 GROUP BY label),
c AS (SELECT c0.label, dim, x / norm AS x FROM c0 JOIN cn USING (label))"""
COS = "s AS (SELECT u.vec_id, c.label AS concept, sum(u.x * c.x) AS cosine FROM u JOIN c USING (dim) GROUP BY 1, 2)"
SOFT = """p AS (SELECT vec_id, concept, exp(cosine) / sum(exp(cosine)) OVER (PARTITION BY vec_id) AS p FROM s),
z AS (SELECT vec_id, arg_min(concept, (-round(p, 12), concept)) AS pred, max(p) AS confidence FROM p GROUP BY vec_id)"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _centroids(spark, sf_dir):
    return modality.mean_vectors(_embeddings(spark, sf_dir), "embedding", ["label"])


def _similar(spark, sf_dir):
    return modality.similarity(_embeddings(spark, sf_dir), "vec_id", "embedding", _centroids(spark, sf_dir), "label", "embedding")


@query(f"WITH {LONG} SELECT vec_id, round(sum(x * x), 6) AS norm2, round(sum(x * (dim + 1)), 6) AS moment FROM u GROUP BY vec_id")
def l2_normalize(spark, sf_dir):
    v = vx.l2_normalize(F.col("embedding"))
    moment = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rounded(_embeddings(spark, sf_dir).select("vec_id", vx.dot(v, v).alias("norm2"), moment.alias("moment")))


@query(f"WITH {LONG} SELECT label, dim::INT AS dim, round(x, 6) AS value FROM c")
def prompt_ensemble(spark, sf_dir):
    """Mean of normalised vectors per class, normalised again."""
    return rounded(_centroids(spark, sf_dir).select("label", F.posexplode("embedding").alias("dim", "value")))


@query(f"""WITH {LONG}, q AS (SELECT vec_id AS q, dim, x FROM u WHERE vec_id % 100 = 0), d AS (SELECT q, vec_id, round(sum(u.x * q.x), 6) AS cosine FROM q JOIN u USING (dim) WHERE vec_id <> q GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM d) SELECT q, vec_id, cosine, rank::INT AS rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """The ten nearest rows of every query id divisible by 100."""
    e = _embeddings(spark, sf_dir)
    near = neighbours.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, "cosine", places=6)
    return near.select("q", F.col("id").alias("vec_id"), (0.0 - F.col("d")).alias("cosine"), "rank")


@query()
def neighbour_blocks(spark, sf_dir):
    """How many blocks of rows each query of the nearest-neighbour search is compared with, of how many."""
    e = _embeddings(spark, sf_dir)
    return neighbours.searched_blocks(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


@query(f"WITH {LONG}, {COS}, {SOFT} SELECT vec_id, pred, round(confidence, 6) AS confidence FROM z")
def softmax_zero_shot(spark, sf_dir):
    return rounded(modality.zero_shot(_similar(spark, sf_dir), "vec_id"))


@query(f"""WITH {LONG}, {COS}, {SOFT}, t AS (SELECT label AS gt, pred AS p FROM z JOIN embeddings USING (vec_id)), k AS (SELECT unnest(range(10)) AS k),
m AS (SELECT k, count(*) FILTER (WHERE p = k AND gt = k) AS tp, count(*) FILTER (WHERE p = k AND gt <> k) AS fp, count(*) FILTER (WHERE gt = k AND p <> k) AS fn FROM k, t GROUP BY k)
SELECT (SELECT round(avg((p = gt)::INT), 6) FROM t) AS accuracy, round(avg(CASE WHEN tp+fp = 0 THEN 0 ELSE tp / (tp+fp) END), 6) AS macro_precision,
       round(avg(CASE WHEN tp+fn = 0 THEN 0 ELSE tp / (tp+fn) END), 6) AS macro_recall, round(avg(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp / (2*tp+fp+fn) END), 6) AS f1_macro, (SELECT count(*) FROM t) AS n FROM m""")
def centroid_classify(spark, sf_dir):
    found = modality.zero_shot(_similar(spark, sf_dir), "vec_id").join(_embeddings(spark, sf_dir).select("vec_id", F.col("label").alias("gt")), "vec_id")
    return rounded(metrics.classification_metrics(found, list(range(10)), []))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT q, vec_id, label, list_sum(list_transform(list_zip(embedding, qv), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q JOIN embeddings ON vec_id <> q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS rn FROM d), v AS (SELECT q, label, count(*) AS v FROM r WHERE rn <= 5 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, label) AS rn FROM v) SELECT q AS vec_id, label AS pred FROM b WHERE rn = 1""")
def knn_classify(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return modality.knn_classify(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "label", 5)


@query("""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS product, len(embedding)::INT AS width FROM embeddings""")
def fuse_mult(spark, sf_dir):
    image, text = F.slice("embedding", 1, IMAGE), F.slice("embedding", IMAGE + 1, DIM - IMAGE)
    product = F.aggregate(vx.fuse(image, text, "mult"), F.lit(0.0), lambda s, x: s + x)
    return rounded(_embeddings(spark, sf_dir).select("vec_id", product.alias("product"), F.size(vx.fuse(image, text, "concat")).alias("width")))


UNC = f"""{LONG}, {COS}, p AS (SELECT vec_id, concept, exp(8 * cosine) / sum(exp(8 * cosine)) OVER (PARTITION BY vec_id) AS p FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, concept) AS rn FROM p),
x AS (SELECT vec_id, -sum(least(1, greatest(1e-15, p)) * log2(least(1, greatest(1e-15, p)))) AS entropy, max(p) AS confidence, max(p) - max(CASE WHEN rn = 2 THEN p END) AS margin,
       max(CASE WHEN rn = 1 THEN concept END) AS predicted FROM k GROUP BY vec_id), z AS (SELECT x.*, (predicted = label)::INT AS correct, label FROM x JOIN embeddings USING (vec_id))"""


def _probabilities(spark, sf_dir):
    s = _similar(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("concept", "cosine"))).alias("s"))
    p = s.select("vec_id", vx.softmax(F.transform("s", lambda r: r["cosine"] * 8)).alias("probs"))
    return uncertainty.uncertainty_rows(p.join(_embeddings(spark, sf_dir).select("vec_id", "label"), "vec_id"), "probs", "label")


@query(f"WITH {UNC} SELECT vec_id, predicted::INT AS predicted, correct, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(entropy, 6) AS entropy FROM z")
def uncertainty_rows(spark, sf_dir):
    return rounded(_probabilities(spark, sf_dir).select("vec_id", "predicted", "correct", "confidence", "margin", "entropy"))


@query(f"""WITH {UNC} SELECT label, round(avg(entropy), 6) AS mean_entropy, round(stddev_samp(entropy), 6) AS std_entropy, round(avg(confidence), 6) AS mean_confidence, round(avg(margin), 6) AS mean_margin,
  round(avg((entropy > 0.5)::INT), 6) AS share_above_05, round(avg((entropy > 0.8)::INT), 6) AS share_above_08 FROM z GROUP BY label""")
def uncertainty_summary(spark, sf_dir):
    return rounded(uncertainty.uncertainty_summary(_probabilities(spark, sf_dir), ["label"]))


@query(f"WITH {LONG}, i AS (SELECT label, sum(abs(x)) FILTER (WHERE dim < 32) AS image, sum(abs(x)) FILTER (WHERE dim >= 32) AS text FROM e GROUP BY label) SELECT label, round(image, 4) AS image, round(text, 4) AS text, round(image * 100 / (image + text), 4) AS image_pct, round(text * 100 / (image + text), 4) AS text_pct FROM i")
def modality_importance(spark, sf_dir):
    return rounded(modality.modality_importance(_embeddings(spark, sf_dir), "embedding", IMAGE, ["label"]), 4)


@query(f"WITH {LONG}, {COS} SELECT concept, round(avg(cosine), 6) AS presence FROM s GROUP BY concept")
def concept_presence(spark, sf_dir):
    return rounded(modality.concept_presence(_similar(spark, sf_dir)))


@query(f"WITH {LONG}, i AS (SELECT dim, round(sum(abs(x)), 4) AS importance FROM e GROUP BY dim ORDER BY 2 DESC, dim LIMIT 5) SELECT i.dim::INT AS dim, importance, c.label AS concept, round(c.x, 6) AS value FROM i JOIN c USING (dim)")
def top_dims(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select(F.posexplode("embedding").alias("dim", "x"))
    importance = e.groupBy("dim").agg(F.round(F.sum(F.abs(F.col("x").cast("double"))), 4).alias("importance"))
    concepts = _centroids(spark, sf_dir).select(F.col("label").alias("concept"), F.col("embedding").alias("vector"))
    return rounded(modality.top_dimensions(importance, concepts, 5))


def _binary(spark, sf_dir):
    e = _embeddings(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))
    d = models.with_features(e, "embedding", "y").select("vec_id", "features", "label", "embedding")
    return features.stratified_split(d, "vec_id", "label")


@query()
def model_sweep(spark, sf_dir):
    """Fit and predict every family; a row each with its status, and its metrics on the test split where it ran."""
    d = _binary(spark, sf_dir)
    rows, status = models.sweep(d.where("split = 'train'"), d.where("split = 'test'"), sorted(models.FAMILIES), "vec_id", DIM, 2)
    return rounded(models.sweep_table(rows, status, [0, 1]))


@query()
def discriminant_analysis(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    model = models.gaussian_discriminant(e, "embedding", "label")
    found = models.discriminant_predict(e, model, "embedding").withColumn("gt", F.col("label"))
    return rounded(metrics.classification_metrics(found, list(range(10)), []))


@query()
def surrogate_fidelity(spark, sf_dir):
    d = _binary(spark, sf_dir)
    black_box = models.estimator("random_forest").fit(d.where("split = 'train'")).transform(d).select("vec_id", "features", "split", F.col("prediction").cast("int").alias("pred"))
    tree, _ = models.surrogate(black_box.where("split = 'train'"))
    return models.fidelity(tree, black_box.where("split = 'test'"))


@query("""WITH m AS (SELECT vec_id, embedding AS v FROM embeddings WHERE label = 0),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS u, b.v AS w, list_sum(list_transform(list_zip(a.v, b.v), lambda z : (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM m a JOIN m b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM d), p AS (SELECT a, b, u, w, i, md5('42:' || a || ':' || i || ':' || b) AS h FROM r, (SELECT unnest([1, 2]) AS i) WHERE rn <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY a, i ORDER BY h) AS rn FROM p), t AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS t FROM o WHERE rn = 1)
SELECT 'synthetic-' || a || '-' || i AS vec_id, round(list_sum(list_transform(list_zip(u, w), lambda z : (z[1]::DOUBLE + (z[2]::DOUBLE - z[1]::DOUBLE) * t))), 3) AS total, 0 AS label FROM t""")
def smote(spark, sf_dir):
    made = features.smote(_embeddings(spark, sf_dir), "vec_id", "embedding", "label", 0, per_row=2)
    return rounded(made.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"), "label"), 3)


@query()
def permutation_importance(spark, sf_dir):
    d = _binary(spark, sf_dir)
    model = models.estimator("decision_tree").fit(d.where("split = 'train'"))
    return rounded(models.permutation_importance(model, d.where("split = 'test'"), "vec_id", DIM, repeats=10))
