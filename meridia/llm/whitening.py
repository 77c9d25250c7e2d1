"""Whitening of embeddings from an exact scatter matrix.

Entries become integers, and every distinct integer vector counts once.  A task
multiplies its vectors modulo several primes: residues are small enough that a
double-precision matrix product of a block is exact.  Residues of all tasks are
summed by Spark, and Chinese remaindering turns them into the exact integer
scatter of vectors that have a one appended, so sums and count come with it.
From it follows the exact covariance, rounded once to double, and its
eigenvectors whiten every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clipped, discard, staged

#: Entries are taken as multiples of ``1 / SCALE``, rounded down.
SCALE = 256
#: Primes lie below ``2 ** PRIME_BITS``; a block of ``BLOCK`` products of centred residues stays below ``2 ** 53``.
PRIME_BITS, BLOCK = 20, 8192
COMPONENTS = 4
_LONG = 2**63


def primes(count: int, bits: int = PRIME_BITS) -> list[int]:
    """The largest ``count`` primes below ``2 ** bits``."""
    found, n = [], (1 << bits) - 1
    while len(found) < count:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
        n -= 2
    return found


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds ``2 * bound``, so integers of at most that size are told apart."""
    return primes(-(-(2 * bound + 1).bit_length() // (PRIME_BITS - 1)))


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers of least size with these residues, by Garner's form of the Chinese remainder theorem."""
    value, product = residues[0].astype(object) % moduli[0], moduli[0]
    for r, p in zip(residues[1:], moduli[1:]):
        value = value + product * (((r.astype(object) - value) * pow(product, -1, p)) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """``x.T @ x`` modulo ``p`` by matrix products in double, exact block by block."""
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for i in range(0, len(x), BLOCK):
        r = (x[i : i + BLOCK] % p).astype(np.float64)
        r -= (r > p // 2) * p
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


@dataclass
class Whitening:
    """``n`` distinct vectors, their exact sums, and components by falling eigenvalue (rows of ``axes``)."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        if len(x) and self.n * (int(np.abs(x.astype(object)).max()) if x.dtype == object else max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, self.sums)) >= _LONG:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """Rows projected on each component, of unit variance; null's place is NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred / self.n).astype(float) @ self.axes.T / np.sqrt(self.values)
        out[:, self.values == 0] = np.nan
        return out


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; none where one exceeds a long."""
    if not len(centred):
        return []
    most = max(abs(int(centred.max())), abs(int(centred.min())))
    if most * most * centred.shape[1] < _LONG:
        return (centred * centred).sum(1).tolist()
    wide = centred.astype(object)
    return [v if v < _LONG else None for v in (wide * wide).sum(1).tolist()]


def integer_vectors(vectors: DataFrame, vector_col: str, *others: str, scale: int = SCALE) -> DataFrame:
    """``others`` and ``x``, each entry times ``scale`` rounded down, of rows whose entries are all finite."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(vector.isNotNull() & (F.size(vector) > 0) & finite)
    return kept.select(*others, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_scatter(fit: DataFrame, n: int, dim: int, most: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and scatter, exact, of integer vectors whose entries are at most ``most`` in size."""
    moduli = primes_for(max(1, n) * max(1, most) ** 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((dim + 1, dim + 1), np.int64) for _ in moduli]
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                x = np.hstack([_matrix(batch), np.ones((batch.num_rows, 1), np.int64)])
                totals = [(t + modular_scatter(x, p)) % p for t, p in zip(totals, moduli)]
        upper = np.triu_indices(dim + 1)
        for k, t in enumerate(totals if seen else []):
            cells = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(cells, k, np.int32), np.arange(cells, dtype=np.int32), t[upper])], names=["prime", "cell", "residue"])

    cells = fit.mapInArrow(work, "prime int, cell int, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue"))
    found = cells.collect()  # primes x dim^2 / 2 numbers, whatever the number of rows
    size = (dim + 1) * (dim + 2) // 2
    residues = [np.zeros(size, np.int64) for _ in moduli]
    for r in found:
        residues[r["prime"]][r["cell"]] = r["residue"] % moduli[r["prime"]]
    full = np.zeros((dim + 1, dim + 1), object)
    upper = np.triu_indices(dim + 1)
    full[upper] = remaindered(residues, moduli)
    full.T[upper] = full[upper]
    return int(full[dim, dim]), [int(v) for v in full[dim, :dim]], full[:dim, :dim]


def exact_covariance(n: int, sums: list[int], scatter: np.ndarray) -> np.ndarray:
    """``(n * scatter - S S') / n^2``: centred in exact integers, each entry rounded once to double."""
    s = np.array(sums, object)
    return ((n * scatter - np.outer(s, s)) / (n * n)).astype(float)


def components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes (rows), eigenvalues and shares of the trace; the largest entry of an axis is positive, rounding-level eigenvalues are 0."""
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:count].copy(), axes[:, ::-1][:, :count].T.copy()
    values[values <= len(covariance) * np.finfo(float).eps * max(values[0], 0.0)] = 0.0
    largest = np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1)
    trace = float(np.trace(covariance))
    return axes * np.where(largest < 0, -1.0, 1.0), values, values / trace if trace > 0 else np.zeros(len(values))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry, by size, of the whitened vectors' covariance minus the identity, over components that have variance."""
    used = np.flatnonzero(model.values > 0)
    k = len(used)
    if not k:
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(model.centred(_matrix(batch)))[:, used]
                own, m = w.mean(0), len(w)
                step, centred = own - mean, w - own
                scatter += centred.T @ centred + np.outer(step, step) * (n * m / (n + m))
                mean, n = mean + step * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=["n", "mean", "scatter"])

    parts = staged(fit.mapInArrow(work, "n long, mean array<double>, scatter array<double>"), "whitened")
    mean = parts.select("n", F.posexplode("mean").alias("at", "m")).groupBy("at").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    mean = F.lit([r["m"] for r in mean.orderBy("at").collect()])
    i, j = F.floor(F.col("at") / k).cast("int"), (F.col("at") % k).cast("int")
    off = lambda at: F.get("mean", at) - F.get(mean, at)
    cells = parts.select("n", "mean", F.posexplode("scatter").alias("at", "s")).groupBy("at").agg((F.sum(F.col("s") + F.col("n") * off(i) * off(j)) / F.sum("n")).alias("c"))
    error = cells.agg(F.max(F.abs(F.col("c") - (i == j).cast("double")))).first()[0]
    discard(parts)
    return error


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> tuple[Whitening, int]:
    """The model of all distinct integer vectors, and their width.

    The width is that of most rows, the larger one on a tie; vectors of other
    widths take no part.  Without a usable vector the model is empty and the
    width 0.  Vectors that repeat count once.
    """
    x = integer_vectors(vectors, vector_col, scale=scale)
    widths = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if widths is None:
        return Whitening(), 0
    dim = widths["dim"]
    fit = staged(x.where(F.size("x") == dim).distinct(), "fit")
    whole = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least")).first()
    n, sums, scatter = exact_scatter(fit, whole["n"], dim, max(abs(whole["most"]), abs(whole["least"])))
    axes, values, explained = components(exact_covariance(n, sums, scatter), min(count, dim))
    model = Whitening(n, sums, axes, values, explained)
    model.identity_error = identity_error(fit, model)
    discard(fit)
    return model, dim


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Null and empty vectors, and those with a null or non-finite entry or
    another width than most, are left out; repeated rows and ids each keep
    their rows, also null ids.  Entries beyond a long count as its end.  A
    component without variance has a null ``whitened`` and 0 explained, and
    takes no part in ``identity_error``, which is null where no component has
    any.  ``deviation`` is null where it exceeds a long.  An empty table gives
    an empty result.
    """
    rows = clipped(vectors, vec_id=id_col, vector=vector_col)
    model, dim = fit_whitening(rows, "vector", count, scale)
    schema = T.StructType([rows.schema["vec_id"], T.StructField("component", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "deviation")], *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    x = integer_vectors(rows, "vector", "vec_id", scale=scale).where(F.size("x") == dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for batch in batches:
            m = batch.num_rows
            if m:
                centred = model.centred(_matrix(batch))
                white = model.whiten(centred).ravel()
                cells = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([d for d in deviations(centred) for _ in range(k)], pa.int64()),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return x.mapInArrow(work, schema)
