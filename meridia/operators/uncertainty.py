"""Prediction uncertainty per row and per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx


def uncertainty_rows(df: DataFrame, probs: str, truth: str) -> DataFrame:
    """Predicted class (first largest), correctness, confidence, margin and entropy in bits; rows without probabilities stay null."""
    p = F.col(probs)
    return df.withColumns(
        {
            "predicted": vx.argmax(p), "correct": (F.col(truth) == vx.argmax(p)).cast("int"), "confidence": F.array_max(p).cast("double"),
            "margin": vx.margin(p), "entropy": vx.entropy_bits(p),
        }
    )


def uncertainty_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means, sample deviation of the entropy, shares above 0.5 and 0.8 bits."""
    e = F.col("entropy")
    return rows.groupBy(*by).agg(
        F.avg(e).alias("mean_entropy"), F.stddev_samp(e).alias("std_entropy"), F.avg("confidence").alias("mean_confidence"), F.avg("margin").alias("mean_margin"),
        F.avg((e > 0.5).cast("int")).alias("share_above_05"), F.avg((e > 0.8).cast("int")).alias("share_above_08"),
    )
