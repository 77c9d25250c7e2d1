"""Local linear explanations (LIME) of any model that is a DataFrame transformation.

Each row is perturbed ``samples`` times by a hash of seed, row id, sample and
feature, so reruns and partitionings agree.  The perturbed rows go through the
model as ordinary Spark rows.  A row's samples stay in one task in order, so
its weighted normal matrix is summed as they stream past, and solved there: no
shuffle, and memory for one row's matrix.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forests import matrix
from .selection import order_statistics

BINS = 4
#: Perturbed rows that one Arrow batch holds, and characters of perturbed text.
ROWS, CHARS = 2000, 2_000_000


def quartile_edges(train: DataFrame, vector_col: str) -> np.ndarray:
    """A row a feature: least value, quartiles and largest value over the training vectors' numbers, exact.

    The quartile of share ``p`` among ``n`` values is the one of rank
    ``ceil(p * n)``, from 1.
    """
    width = train.agg(F.max(F.size(vector_col)).alias("d")).first()["d"] or 0
    entry = [F.get(vector_col, F.lit(i)).cast("double") for i in range(max(0, width))]
    values = train.select(*[F.when(~F.isnan(v), v).alias(f"f{i}") for i, v in enumerate(entry)])
    counts = values.agg(F.lit(0).alias("none"), *[F.count(c).alias(c) for c in values.columns]).first()
    shares = {c: [0, *[math.ceil(counts[c] * p) - 1 for p in (0.25, 0.5, 0.75)], counts[c] - 1] for c in values.columns if counts[c]}
    found = order_statistics(values, shares) if shares else {}
    return np.array([[found[c][r] for r in shares[c]] if c in shares else [0.0] * 5 for c in values.columns], float).reshape(-1, 5)


def draws(seed: int, name, samples: int, width: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for every sample and feature of a row: 32 bits of MD5 of ``seed:name:sample:feature``."""
    parts = [hashlib.md5(f"{seed}:{name}:{s}:{f}".encode()).digest()[:4] for s in range(samples) for f in range(width)]
    return (np.frombuffer(b"".join(parts), ">u4") / 2.0**32).reshape(samples, width)


def perturbed(x: np.ndarray, edges: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and same-bin flags of each sample: four bins a feature, equally likely, uniform within; the first sample is the row itself."""
    own = np.minimum((x[None] > edges[:, 1:4].T).sum(0), BINS - 1)
    drawn = np.minimum((u * BINS).astype(int), BINS - 1)
    drawn[0] = own
    lo = np.take_along_axis(edges[None].repeat(len(u), 0), drawn[:, :, None], 2)[:, :, 0]
    hi = np.take_along_axis(edges[None].repeat(len(u), 0), drawn[:, :, None] + 1, 2)[:, :, 0]
    values = lo + (u * BINS - np.floor(u * BINS)) * (hi - lo)
    values[0] = x
    return values, (drawn == own).astype(float)


def kernel(flags: np.ndarray) -> np.ndarray:
    """Weights of samples by the number of features that left the row's own bin; width 0.75 times the root of the features."""
    width = 0.75 * math.sqrt(flags.shape[1])
    return np.sqrt(np.exp(-(flags.shape[1] - flags.sum(1)) / width**2))


def solve_weighted(normal: np.ndarray, right: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights of a weighted normal matrix whose last row and column belong to the intercept, which isn't shrunk."""
    penalty = ridge * np.eye(len(normal))
    penalty[-1, -1] = 1e-12
    return np.linalg.solve(normal + penalty, right)


def tabular_samples(rows: DataFrame, edges: np.ndarray, id_col: str, vector_col: str, samples: int, seed: int) -> DataFrame:
    """``id, sample, weight, vector, flags``: all samples of each row with a full vector, row after row."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    double = T.ArrayType(T.DoubleType())
    schema = T.StructType([rows.schema[id_col], T.StructField("sample", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("vector", double), T.StructField("flags", double)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for batch in batches:
            known = matrix(batch.column(1), len(edges))
            for i in np.flatnonzero(~np.isnan(known).any(1)).tolist():
                values, flags = perturbed(known[i], edges, draws(seed, batch.column(0)[i].as_py(), samples, len(edges)))
                weights = kernel(flags)
                for start in range(0, samples, ROWS):
                    at = slice(start, start + ROWS)
                    n = len(values[at])
                    cells = [batch.column(0).take(pa.array([i] * n)), pa.array(np.arange(start, start + n, dtype=np.int32)), pa.array(weights[at]), pa.array(list(values[at])), pa.array(list(flags[at]))]
                    yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return rows.select(id_col, vector_col).mapInArrow(work, schema)


def local_fits(scored: DataFrame, id_col: str, samples: int, ridge: float, flags: str = "flags", score: str = "score") -> DataFrame:
    """``id, weights, intercept, fit, normal``: a row's local model, its weighted R2 and its packed normal matrix.

    ``scored`` is what ``tabular_samples`` or ``text_samples`` gave with a
    ``score`` column, in its order: samples 0 to ``samples - 1`` of one row,
    then those of the next.
    """
    double = T.ArrayType(T.DoubleType())
    schema = T.StructType([scored.schema[id_col], T.StructField("weights", double), T.StructField("intercept", T.DoubleType()), T.StructField("fit", T.DoubleType()), T.StructField("normal", double)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = right = None
        name, squares, total, mass = None, 0.0, 0.0, 0.0
        for batch in batches:
            number = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] == 0) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                z = np.stack([np.append(f, 1.0) for f in part.column(3).to_numpy(zero_copy_only=False)]) if len(part) else None
                w, y = part.column(2).to_numpy(), part.column(4).to_numpy()
                if number[lo] == 0:
                    name, normal, right, squares, total, mass = part.column(0).slice(0, 1), 0.0, 0.0, 0.0, 0.0, 0.0
                normal, right = normal + z.T @ (z * w[:, None]), right + z.T @ (w * y)
                squares, total, mass = squares + float(w @ (y * y)), total + float(w @ y), mass + float(w.sum())
                if number[hi - 1] == samples - 1:
                    found = solve_weighted(normal, right, ridge)
                    rest = squares - 2 * float(found @ right) + float(found @ normal @ found)
                    spread = squares - total * total / mass
                    fit = 1.0 - rest / spread if spread > 1e-12 * max(1.0, squares) else 0.0
                    yield pa.RecordBatch.from_arrays([name, pa.array([found[:-1]]), pa.array([float(found[-1])]), pa.array([fit]), pa.array([normal.ravel()])], names=schema.names)

    return scored.select(id_col, "sample", "weight", flags, F.col(score).cast("double").alias("score")).mapInArrow(work, schema)


def explain_rows(
    rows: DataFrame, train: DataFrame, predict: Callable[[DataFrame], DataFrame], id_col: str, vector_col: str, samples: int = 500, ridge: float = 1.0, seed: int = 42
) -> DataFrame:
    """``id, weights, intercept, fit, normal`` for every row with a full vector.

    ``predict`` takes a DataFrame with a column ``vector`` and returns it with
    ``score``, row by row in place (a model's ``transform``, any expression).
    A weight tells what it adds to the score that a feature stays in the row's
    own quartile.  Rows whose vector is null, incomplete or of another width
    than the training vectors are left out; repeated ids get equal samples.
    """
    drawn = tabular_samples(rows, quartile_edges(train, vector_col), id_col, vector_col, samples, seed)
    return local_fits(predict(drawn), id_col, samples, ridge)


def words_of(text: str | None) -> list[str]:
    """Distinct words, by first appearance, cut at blanks."""
    return list(dict.fromkeys((text or "").split()))


def text_samples(rows: DataFrame, id_col: str, text_col: str, samples: int, seed: int) -> DataFrame:
    """``id, sample, weight, text, flags``: each text with random distinct words removed; the first sample is the whole text.

    A sample removes each word whose hash number falls below its share, which
    differs from sample to sample; weights fall with the cosine distance of the
    flags to all ones.  A text without words has no samples.
    """
    schema = T.StructType([rows.schema[id_col], T.StructField("sample", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("flags", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                tokens = text.as_py().split()
                place = {w: j for j, w in enumerate(words)}
                at = np.array([place[w] for w in tokens])
                step = max(1, min(ROWS, CHARS // max(1, len(text.as_py()))))
                for start in range(0, samples, step):
                    flags, texts = [], []
                    for s in range(start, min(samples, start + step)):
                        rng = np.random.default_rng(list(hashlib.md5(f"{seed}:{batch.column(0)[i].as_py()}:{s}".encode()).digest()))
                        keep = np.ones(len(words), bool) if s == 0 else rng.random(len(words)) >= rng.random()
                        flags.append(keep.astype(float))
                        texts.append(" ".join(t for t, k in zip(tokens, keep[at].tolist()) if k))
                    share = np.array([f.mean() for f in flags])
                    weights = np.sqrt(np.exp(-((100 * (1 - np.sqrt(share))) ** 2) / 25**2))
                    n = len(flags)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), pa.array(np.arange(start, start + n, dtype=np.int32)), pa.array(weights), pa.array(texts), pa.array(flags)], names=schema.names)

    return rows.select(id_col, text_col).mapInArrow(work, schema)


def explain_texts(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], id_col: str, text_col: str, samples: int = 500, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """``id, weights, intercept, fit, normal`` for every text with a word; weights in the order of ``words_of``.

    ``predict`` takes a DataFrame with a column ``text`` and returns it with
    ``score``.  Whole texts are explained, so a row's matrix has the square of
    its distinct words.
    """
    return local_fits(predict(text_samples(rows, id_col, text_col, samples, seed)), id_col, samples, ridge)
