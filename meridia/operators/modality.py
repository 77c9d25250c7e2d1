"""Modality and concept audits of embeddings, zero-shot and nearest-neighbour classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .neighbours import nearest

MOST_CONCEPTS = 10_000


def modality_importance(df: DataFrame, values: str, width: int, by: list[str], empty_share: float = 0.0) -> DataFrame:
    """Absolute importance of the first ``width`` dimensions (image) against the rest (text), and percentages.

    A total of 0 gives ``empty_share`` for both.
    """
    long = df.select(*by, F.posexplode(values).alias("dim", "v"))
    image, text = (F.coalesce(F.sum(F.when(c, F.abs("v").cast("double"))), F.lit(0.0)) for c in (F.col("dim") < width, F.col("dim") >= width))
    sums = long.groupBy(*by).agg(image.alias("image"), text.alias("text"))
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100, F.col("image") + F.col("text")), F.lit(empty_share))
    return sums.withColumns({"image_pct": pct("image"), "text_pct": pct("text")})


def mean_vectors(df: DataFrame, vector: str, by: list[str], normalize: bool = True) -> DataFrame:
    """Mean of (normalised) vectors per group, normalised again: prompt ensembles and class centroids.

    The mean is taken per dimension, so the shuffle carries one partial sum a
    group and dimension.
    """
    v = vx.l2_normalize(F.col(vector)) if normalize else F.col(vector)
    mean = df.select(*by, F.posexplode(v).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"))
    out = whole.select(*by, F.transform("d", lambda s: s["x"]).alias(vector))
    return out.withColumn(vector, vx.l2_normalize(F.col(vector))) if normalize else out


def similarity(df: DataFrame, id_col: str, vector: str, concepts: DataFrame, name: str, concept: str) -> DataFrame:
    """Cosine of every row with every concept; the concepts (classes, prompts) are at most ``MOST_CONCEPTS``."""
    small = concepts.select(F.col(name).alias("concept"), F.col(concept).alias("cv"))
    if small.count() > MOST_CONCEPTS:
        raise ValueError(f"more than {MOST_CONCEPTS} concepts; neighbours.nearest is the way for large sets")
    small = F.broadcast(small)
    return df.select(id_col, vector).crossJoin(small).select(id_col, "concept", vx.cosine(F.col(vector), F.col("cv")).alias("cosine"))


def concept_presence(similarities: DataFrame) -> DataFrame:
    return similarities.groupBy("concept").agg(F.avg("cosine").alias("presence"))


def zero_shot(similarities: DataFrame, id_col: str) -> DataFrame:
    """Softmax of the cosines per row (no scale), best concept first on ties by name."""
    w = Window.partitionBy(id_col)
    soft = similarities.withColumn("p", F.exp("cosine") / F.sum(F.exp("cosine")).over(w))
    return soft.groupBy(id_col).agg(F.min_by("concept", F.struct(-F.col("p"), F.col("concept"))).alias("pred"), F.max("p").alias("confidence"))


def flip_average(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(a, F.zip_with(a, b, lambda x, y: (x + y) / 2))


def top_dimensions(importance: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most important dimensions and every concept's value there.

    ``importance``: ``dim, importance``; ``concepts``: ``concept, vector``.
    """
    top = importance.orderBy(F.desc("importance"), "dim").limit(k)
    values = concepts.select("concept", F.posexplode("vector").alias("dim", "value"))
    return values.join(F.broadcast(top), "dim").select("dim", "importance", "concept", F.col("value").cast("double").alias("value"))


def knn_classify(queries: DataFrame, train: DataFrame, id_col: str, vector: str, label: str, k: int) -> DataFrame:
    """Exact k-nearest-neighbour vote by Euclidean distance, ties by distance, id and smaller label."""
    near = nearest(queries, train, id_col, vector, k).join(train.select(F.col(id_col).alias("id"), F.col(label).alias("y")), "id")
    votes = near.groupBy("q", "y").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy(F.col("q").alias(id_col)).agg(F.min_by("y", F.struct(-F.col("v"), F.col("y"))).alias("pred"))
