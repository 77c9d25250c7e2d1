"""Sinks.  Spark's own writers; a report that fits a page is rendered from collected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON, one folder per model, split and task."""
    results.write.mode("overwrite").partitionBy("model", "split", "task").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_ranked(table: DataFrame, path: str, metric: str) -> None:
    """A leaderboard as one CSV, best first, rows without the metric last."""
    table.orderBy(F.desc_nulls_last(metric)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_wide_predictions(long: DataFrame, path: str, models: list[str], with_row_id: bool = False) -> None:
    """``Actual`` and one column a model; with ``row_id``, files can be joined by row."""
    wide = long.groupBy("row_id").pivot("model", models).agg(F.first("pred"))
    actual = long.groupBy("row_id").agg(F.first("actual").alias("Actual"))
    rows = actual.join(wide, "row_id")
    (rows if with_row_id else rows.drop("row_id")).write.mode("overwrite").csv(path, header=True)


def write_table(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A small report table as one CSV, sorted if asked: uncertainty, profiles, modality shares."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_box_labels(truth: DataFrame, path: str) -> None:
    """Training labels of detectors as text: per image a line ``class cx cy w h``; boxes are shares of the image."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[F.col(c).cast("string") for c in ("cx", "cy", "w", "h")])
    truth.select("image_id", line.alias("value")).write.mode("overwrite").partitionBy("image_id").text(path)


def full_image_boxes(images: DataFrame, class_id: int = 0) -> DataFrame:
    """One box a image that covers it whole."""
    return images.select("image_id", F.lit(class_id).alias("class_id"), *[F.lit(v).alias(c) for c, v in (("cx", 0.5), ("cy", 0.5), ("w", 1.0), ("h", 1.0))])


def write_embeddings(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("overwrite").parquet(path)


def metrics_payload(models: DataFrame, task: str, split: str, variant: str, best: str) -> DataFrame:
    """One nested row: task, split, variant, best model and all models' rows."""
    rows = models.agg(F.sort_array(F.collect_list(F.struct(*[c for c in models.columns]))).alias("models"))
    return rows.select(F.lit(task).alias("task"), F.lit(split).alias("split"), F.lit(variant).alias("variant"), F.lit(best).alias("best_model"), "models")


def markdown_table(rows: DataFrame, limit: int = 100) -> str:
    """A Markdown table of at most ``limit`` rows (a report, not data)."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join("N/A" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines)
