"""Scores of explanations against references: BLEU, ROUGE-L, reference rationales."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import unicode_tokens


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def clipped_matches(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Matched 1- to 4-grams of two token arrays, each counted at most as often as the reference has it."""

    def one(r, h) -> list[int]:
        r, h = list(r), list(h)
        grams = lambda x, n: Counter(zip(*(x[i:] for i in range(n))))
        return [(grams(r, n) & grams(h, n)).total() for n in range(1, 5)]

    return pd.Series([one(r, h) for r, h in zip(ref, hyp)])


def bleu(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """``bleu_1, bleu_4`` of texts: add-0.1 smoothed clipped precisions and brevity penalty; 0 for an empty side."""
    t = df.withColumns({"__r": unicode_tokens(F.col(ref)), "__h": unicode_tokens(F.col(hyp))})
    t = t.withColumns({"__m": clipped_matches("__r", "__h"), "__nr": F.size("__r"), "__nh": F.size("__h")})
    logs = [F.log((F.col("__m")[n - 1] + 0.1) / (F.greatest(F.col("__nh") - (n - 1), F.lit(1)) + 0.1)) for n in range(1, 5)]
    r, h = F.col("__nr"), F.col("__nh")
    penalty = F.when(h > r, 1.0).otherwise(F.exp(1 - r / F.greatest(h, F.lit(1))))
    some = (r > 0) & (h > 0)
    mean = (logs[0] + logs[1] + logs[2] + logs[3]) / 4.0
    out = t.withColumns({"bleu_1": F.when(some, penalty * F.exp(logs[0])).otherwise(0.0), "bleu_4": F.when(some, penalty * F.exp(mean)).otherwise(0.0)})
    return out.select(*df.columns, "bleu_1", "bleu_4")


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays, by rows of bits."""

    def one(x, y) -> int:
        places: dict[str, int] = {}
        for i, w in enumerate(x):
            places[w] = places.get(w, 0) | 1 << i
        row = (1 << len(x)) - 1
        full = row
        for w in y:
            hit = row & places.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def rouge_l(df: DataFrame, ref: str, hyp: str, beta2: float = 1.21) -> DataFrame:
    """``lcs, rouge_l`` of texts; 0 for an empty side."""
    r, h = unicode_tokens(F.col(ref)), unicode_tokens(F.col(hyp))
    t = df.withColumn("lcs", lcs_length(r, h))
    p, q = F.try_divide(F.col("lcs").cast("double"), F.size(h)), F.try_divide(F.col("lcs").cast("double"), F.size(r))
    return t.withColumn("rouge_l", F.coalesce(F.try_divide((1 + beta2) * p * q, beta2 * p + q), F.lit(0.0)))


def score_summary(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean and population standard deviation of each score."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def reference_rationale(label: Column) -> Column:
    """A template by label; an unknown label counts as positive."""
    positive = "The item is classified as harmful because its words or images demean or stereotype a group of people."
    negative = "The item is classified as harmless because nothing in it demeans or stereotypes a group of people."
    return F.when(F.coalesce(label, F.lit(1)) == 1, positive).otherwise(negative)
