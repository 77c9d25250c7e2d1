"""Exact order statistics of whole columns in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a key that one pass settles; four passes settle a double.
BITS = 16


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of doubles: -0 is 0, NaN comes last."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(2**63)


def value_of(key: int) -> float:
    bits = np.array([key ^ 2**63], np.uint64).view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values of some ranks, from 0, among the non-null values of each column.

    A pass counts, for every column and every prefix of key bits that a wanted
    rank lies under, the next ``BITS`` bits; a task sends on a count for each
    it meets, so nothing holds the column's values.  Spark adds the counts up
    along a prefix's digits, and the driver gets the digit of each wanted rank.
    All columns and ranks share the passes.
    """
    columns = list(ranks)
    at = {(c, r): (0, r) for c in columns for r in ranks[c]}  # prefix so far, rank under it
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    for shift in range(64 - BITS, -1, -BITS):
        wanted = [sorted({p for (c, _), (p, _) in at.items() if c == name}) for name in columns]

        def work(batches: Iterator[pa.RecordBatch], wanted=wanted, shift=shift) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, prefixes in enumerate(wanted):
                    keys = sortable(batch.column(i).drop_null().to_numpy(zero_copy_only=False).astype(float))
                    under = keys >> np.uint64(shift + BITS) if shift + BITS < 64 else np.zeros(len(keys), np.uint64)
                    for prefix in prefixes:
                        digits, counts = np.unique((keys[under == prefix] >> np.uint64(shift)) & np.uint64(2**BITS - 1), return_counts=True)
                        n = len(digits)
                        yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([str(prefix)] * n, pa.string()), pa.array(digits.astype(np.int32)), pa.array(counts)], names=["column", "prefix", "digit", "n"])

        counts = rows.mapInArrow(work, "column int, prefix string, digit int, n long").groupBy("column", "prefix", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("column", "prefix").orderBy("digit")
        counts = counts.withColumn("upto", F.sum("n").over(upto))
        sought = sorted({(columns.index(c), str(prefix), left) for (c, _), (prefix, left) in at.items()})
        sought = df.sparkSession.createDataFrame(sought, "column int, prefix string, left long")
        under = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        found = {(r["column"], int(r["prefix"]), r["left"]): (r["digit"], r["left"] - r["upto"] + r["n"]) for r in counts.join(F.broadcast(sought), ["column", "prefix"]).where(under).collect()}
        for (name, rank), (prefix, left) in at.items():
            if (columns.index(name), prefix, left) not in found:
                raise IndexError(f"{name} has no value of rank {rank}")
            digit, rest = found[columns.index(name), prefix, left]
            at[name, rank] = (prefix << BITS | digit, rest)
    out: dict[str, dict[int, float]] = {c: {} for c in columns}
    for (name, rank), (key, _) in at.items():
        out[name][rank] = value_of(key)
    return out


def exact_quantiles(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring ranks; None for a column without a value."""
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(shares)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(shares)}
    places = {c: [p * (sizes[c] - 1) for p in ps] for c, ps in shares.items() if sizes[c]}
    found = order_statistics(df, {c: sorted({f(x) for x in xs for f in (math.floor, math.ceil)}) for c, xs in places.items()}) if places else {}
    out: dict[str, list[float | None]] = {}
    for c, ps in shares.items():
        out[c] = [None] * len(ps)
        for i, x in enumerate(places.get(c, [])):
            lo, hi = found[c][math.floor(x)], found[c][math.ceil(x)]
            out[c][i] = lo if lo == hi else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi
    return out
