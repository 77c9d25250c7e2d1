"""The column transformer: numeric and categorical columns of a table as one feature array with names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .filters import columns_by_kind

#: Levels a categorical column may have; each is a feature.
MOST_LEVELS = 1_000


@dataclass(frozen=True)
class Prepared:
    """``rows`` has the feature array beside the columns that were kept; ``names`` are its places."""

    rows: DataFrame
    names: list[str]


def prepare(df: DataFrame, train: DataFrame, columns: list[str], keep: list[str], impute: str = "mean", scaling: str = "standard", encoding: str = "onehot") -> Prepared:
    """Impute and scale numeric columns, impute and encode all others, drop what is left; fitted on ``train`` alone.

    Names are the numeric columns' own, then ``<column>_<level>`` for one-hot
    levels or the column's own for ordinals.  An unknown or null level is all
    zeros, or -1.  Numeric nulls stay null under ``ignore``.
    """
    numeric, categorical = columns_by_kind(df, columns)
    both = df.select(*keep, *columns, F.lit(False).alias("__train")).unionByName(train.select(*keep, *columns, F.lit(True).alias("__train")))
    fitted = lambda d: d.where("__train")
    if numeric:
        both = features.impute_numeric(both, fitted(both), numeric, impute)
        both = features.scale(both, fitted(both), numeric, scaling)
    if categorical:
        both = features.impute_categorical(both, fitted(both), categorical, impute)
    parts, names = [F.array(*[F.col(c).cast("double") for c in numeric])] if numeric else [], list(numeric)
    for c in categorical:
        if encoding == "onehot":
            levels = [r["value"] for r in features.category_levels(fitted(both), c).orderBy("level").limit(MOST_LEVELS + 1).collect()]
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
            parts.append(F.array(*[F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in levels]) if levels else F.array().cast("array<double>"))
            names += [f"{c}_{v}" for v in levels]
        elif encoding == "ordinal":
            both = features.ordinal_encode(both, fitted(both), c)
            parts.append(F.array(F.col(f"{c}_level").cast("double")))
            names.append(c)
        else:
            raise ValueError(f"unknown encoding {encoding!r}")
    vector = F.concat(*parts) if parts else F.array().cast("array<double>")
    return Prepared(both.where("not __train").select(*keep, vector.alias("features")), names)
