"""Leaderboards, comparison of splits, gating of one task by another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted metric names and the columns they rank by.
METRIC_COLUMNS = {"f1": "f1_macro", "macro_f1": "f1_macro", "accuracy": "accuracy", "roc_auc": "roc_auc", "score_b": "score_b", "precision": "macro_precision", "recall": "macro_recall"}


def metric_column(df: DataFrame, name: str) -> str:
    """The column a metric name means: mapped, or case-insensitively, else accuracy, else the first number."""
    wanted = METRIC_COLUMNS.get(name.strip().lower(), name)
    found = {c.lower(): c for c in df.columns}
    if wanted.lower() in found:
        return found[wanted.lower()]
    if "accuracy" in found:
        return found["accuracy"]
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    if not numeric:
        raise ValueError("no numeric column to rank by")
    return numeric[0]


def _best_first(metric: str, ordinal: str) -> list[Column]:
    return [F.desc_nulls_last(F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))), F.asc(ordinal)]


def leaderboard(df: DataFrame, metric: str, ordinal: str) -> DataFrame:
    """``rank`` by metric, best first, null and NaN last, ties by ``ordinal``; one row a model."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*_best_first(metric, ordinal))))


def best_row(df: DataFrame, metric: str, ordinal: str) -> DataFrame:
    return df.orderBy(*_best_first(metric, ordinal)).limit(1)


def top_k(df: DataFrame, by: str, k: int, ordinal: str, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(by) if largest else F.asc(by), ordinal).limit(k)


def balanced_head(df: DataFrame, label: str, n: int, ordinal: str) -> DataFrame:
    """The first ``n`` rows of every class."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(ordinal))
    return df.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def filters_in_order(df: DataFrame, column: str = "filter") -> DataFrame:
    """Distinct filters, ``none`` first, then by name."""
    return df.select(column).distinct().orderBy((F.col(column) != "none").cast("int"), column)


def compare_splits(validation: DataFrame, test: DataFrame, models: DataFrame, metric: str) -> DataFrame:
    """Validation and test figure of every configured model, each null where missing, and their gap."""
    v = validation.select("model", F.col(metric).alias("validation"))
    t = test.select("model", F.col(metric).alias("test"))
    out = models.select("model").join(v, "model", "left").join(t, "model", "left")
    return out.withColumn("gap", F.col("validation") - F.col("test"))


def ablation(results: DataFrame, models: DataFrame, subsets: DataFrame, base: str, changed: str, metric: str) -> DataFrame:
    """Base and changed figure over the whole grid of models and subsets; missing stays null."""
    grid = models.select("model").crossJoin(subsets.select("subset"))
    side = lambda f, n: results.where(F.col("filter") == f).select("model", "subset", F.col(metric).alias(n))
    out = grid.join(side(base, "base"), ["model", "subset"], "left").join(side(changed, "changed"), ["model", "subset"], "left")
    return out.withColumn("difference", F.col("changed") - F.col("base"))


def last_per_id(df: DataFrame, id_col: str, ordinal: str) -> DataFrame:
    """Of rows with one id the last by ``ordinal``."""
    rest = [c for c in df.columns if c != id_col]
    last = df.groupBy(id_col).agg(F.max_by(F.struct(*rest), ordinal).alias("row"))
    return last.select(id_col, "row.*")


def gate(first: DataFrame, second: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Second-stage predictions with all zeros where the first stage said no (or nothing).

    ``first``: id and ``pred``, one row an id (see ``last_per_id``); ``second``:
    id and ``pred`` array.  Ids without a first-stage row are left out.
    """
    joined = second.join(first.select(id_col, F.coalesce("pred", F.lit(0)).alias("open")), id_col)
    zeros = F.transform("pred", lambda _: F.lit(0))
    return joined.withColumn("gated", (F.col("open") == 0)).withColumn("pred", F.when(F.col("gated"), zeros).otherwise(F.col("pred"))).drop("open")
