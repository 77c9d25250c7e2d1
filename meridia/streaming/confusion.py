"""A Spark-native extension without a model in the source material: running metrics over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import confusion, per_label


def windowed_confusion(stream: DataFrame, ts: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Confusion counts and metrics of ``pred, gt`` per event-time window.

    Works on a stream (append mode once the watermark passes a window) and on a
    static table alike.
    """
    marked = stream.withWatermark(ts, late).withColumn("window", F.window(ts, width))
    return per_label(confusion(marked, ["window"]))
