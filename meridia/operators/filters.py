"""Row and column filters, and the strict pairing of predictions with their truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_target(df: DataFrame, target: str, text: str | None = None) -> DataFrame:
    """Rows whose target, and text if one is named, isn't null."""
    keep = F.col(target).isNotNull()
    return df.where(keep & F.col(text).isNotNull() if text else keep)


def feature_columns(df: DataFrame, target: str, wanted: list[str] | None = None, excluded: list[str] | None = None) -> list[str]:
    """The wanted columns that exist, or all but the target and the excluded ones, in table order."""
    if wanted:
        return [c for c in wanted if c in df.columns]
    return [c for c in df.columns if c != target and c not in (excluded or [])]


def columns_by_kind(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """Numeric columns and all others."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [c for c in columns if c in numeric], [c for c in columns if c not in numeric]


def has_detection(boxes: Column, least: float = 0.25) -> Column:
    """Whether any box of an array of detections is confident enough; null and empty arrays have none."""
    return F.coalesce(F.exists(boxes, lambda b: b["confidence"] >= least), F.lit(False))


def ranked_rows(df: DataFrame, metric: str, status: str = "status") -> DataFrame:
    """Rows whose run went well and whose metric is a number."""
    return df.where((F.col(status) == "OK") & F.col(metric).try_cast("double").isNotNull())


def of_origin(df: DataFrame, origin: str, metric: str) -> DataFrame:
    """Rows of one origin whose printed metric is a number; ``N/A`` goes."""
    return df.where((F.col("origin") == origin) & F.col(metric).try_cast("double").isNotNull())


def of_mode(df: DataFrame, mode: str | None = None, binary: bool | None = None) -> DataFrame:
    out = df if mode is None else df.where(F.col("mode") == mode)
    return out if binary is None else out.where(F.col("binary").eqNullSafe(F.lit(binary)))


def has_negative(df: DataFrame, vector: str) -> bool:
    """Whether any element is below 0, which count models can't take."""
    return not df.where(F.array_min(vector) < 0).isEmpty()


def in_group(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a member's."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def pair_strictly(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions beside their truth by key; a key that one side lacks or repeats is a ``ValueError``."""
    sides = predictions.select(key, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(key, F.lit(0).alias("p"), F.lit(1).alias("t")))
    uneven = sides.groupBy(key).agg(F.sum("p").alias("p"), F.sum("t").alias("t")).where("p <> 1 or t <> 1")
    if not uneven.isEmpty():
        first = uneven.orderBy(key).first()
        raise ValueError(f"predictions and truth differ: {key} {first[0]!r} has {first['p']} and {first['t']} rows")
    return predictions.join(truth, key)
