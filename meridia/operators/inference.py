"""The boundary to models Spark doesn't run: an inferencer maps Arrow batches to answers.

Real networks plug in here; the rule and centroid scorers make everything
downstream testable offline.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import struct

ANSWER = struct("prediction string, confidence double, latency_s double, refusal boolean, failed boolean")


class Inferencer(Protocol):
    """Loads in ``open`` once a task; answers a pandas batch with the ``ANSWER`` columns but ``failed``."""

    def open(self) -> None: ...

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def infer(df: DataFrame, inferencer: Inferencer, id_col: str) -> DataFrame:
    """``id`` and answers; a failing batch yields null predictions marked ``failed``, which are no refusals."""
    schema = T.StructType([df.schema[id_col], *ANSWER.fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inferencer.open()
        for batch in batches:
            try:
                out = inferencer.answer(batch).assign(failed=False)[[f.name for f in ANSWER.fields]]
            except Exception:
                out = pd.DataFrame({"prediction": None, "confidence": 0.0, "latency_s": 0.0, "refusal": False, "failed": True}, index=batch.index)
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    return df.mapInPandas(work, schema)


class KeywordInferencer:
    """Answers ``yes`` where a text holds one of some words."""

    def __init__(self, words: list[str], text_col: str = "text"):
        self.words, self.text_col = words, text_col

    def open(self) -> None:
        self.found = [w.lower() for w in self.words]

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        low = batch[self.text_col].fillna("").str.lower()
        hit = low.map(lambda t: any(w in t for w in self.found))
        return pd.DataFrame({"prediction": hit.map({True: "yes", False: "no"}), "confidence": hit.map({True: 0.9, False: 0.6}), "latency_s": 0.0, "refusal": False})


def rule_scores(text: Column, n_chars: Column) -> tuple[Column, Column]:
    """The built-in quality and toxicity rules as predictions."""
    return (n_chars >= 200).cast("int"), F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("a")).cast("int")
