"""Exact nearest neighbours of a stated query set, by pivots and the triangle inequality.

Rows belong to the cell of their nearest pivot, cells are cut into blocks.  What
is known of a cell (its rows' number and their least and largest distance from
the pivot) bounds how near its rows can be to a query, and how far its ``k``
nearest rows are at most.  A query is sent to the blocks of those cells only
that can hold one of its neighbours; a block's rows travel once, queries stream
past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Rows of a block, pivots at most, and queries compared with a block at a time.
BLOCK, PIVOTS, AT_ONCE = 2_000, 256, 200


def _vectors(batch: pa.RecordBatch, place: int) -> np.ndarray:
    lists = batch.column(place)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _units(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0))


@dataclass
class Cells:
    """Pivots, and each cell's rows and distances from its pivot; the last cell holds zero vectors under ``cosine``."""

    pivots: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray
    cosine: bool

    def reach(self, x: np.ndarray, k: int, slack: float) -> np.ndarray:
        """Which cells can hold one of the ``k`` nearest rows of each query, itself not counted."""
        if self.cosine:
            zero = ~x.any(1)
            x = _units(x)
        d = _far(x, self.pivots)
        full = self.count > 0
        far = np.where(full[:-1], d + self.most[:-1], np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(self.count[:-1][order], axis=1) >= k + 1
        theta = np.where(enough.any(1), np.take_along_axis(far, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], np.inf)
        near = np.maximum(d - self.most[:-1], self.least[:-1] - d)
        between = _far(self.pivots, self.pivots)
        for j in np.unique(d.argmin(1)).tolist():  # rows of a cell are no farther from its pivot than from the query's
            own = np.flatnonzero(d.argmin(1) == j)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[j] > 0, (d[own] ** 2 - d[own, j][:, None] ** 2) / (2 * between[j]), 0.0)
            near[own] = np.maximum(near[own], plane)
        near = np.maximum(near, 0.0)
        found = (near**2 <= (theta**2 + slack)[:, None] * (1 + 1e-9) + 1e-9) & full[:-1]
        if self.cosine:
            found[zero] = full[:-1]
        return np.hstack([found, np.full((len(x), 1), full[-1])])


def _assigned(rows: DataFrame, pivots: np.ndarray, cosine: bool, id_type) -> DataFrame:
    """``id, v, cell, far`` of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, 1)
                zero = ~x.any(1) if cosine else np.zeros(len(x), bool)
                d = _far(_units(x) if cosine else x, shared.value)
                cell = np.where(zero, len(shared.value), d.argmin(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.where(zero, 0.0, d.min(1)))], names=["id", "v", "cell", "far"])

    return rows.mapInArrow(work, f"id {id_type}, v array<double>, cell int, far double")


def _searches(asked: DataFrame, cells: Cells, k: int, slack: float, id_type) -> DataFrame:
    """``id, v, cell``: each query beside every cell it has to search."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                row, cell = np.nonzero(shared.value.reach(_vectors(part, 1), k, slack))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in part.columns], pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return asked.mapInArrow(work, f"id {id_type}, v array<double>, cell int")


def _planned(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, metric: str, places: int | None) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Assigned rows, searches, ``cell, blocks``, and the rows' scratch path."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    spark, cosine = rows.sparkSession, metric == "cosine"
    kind = dict(rows.dtypes)[id_col]
    as_rows = lambda df: df.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    held, asked = as_rows(rows), as_rows(queries)
    n = held.count()
    picked = held.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, math.isqrt(n)))).collect()  # a documented sample
    pivots = np.array([r["v"] for r in picked], float).reshape(len(picked), -1)
    pivots = np.unique(_units(pivots) if cosine else pivots, axis=0)
    path = scratch_path(spark, "cells")
    _assigned(held, pivots, cosine, kind).write.parquet(path)
    held = spark.read.parquet(path)
    cells = Cells(pivots, *[np.zeros(len(pivots) + 1) for _ in range(3)], cosine)
    for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect():  # a row a pivot
        cells.count[r["cell"]], cells.least[r["cell"]], cells.most[r["cell"]] = r["n"], r["least"], r["most"]
    # Similarities that round alike tie: what lies within the rounding must be searched, too.
    slack = 4 * 10.0**-places if cosine and places is not None else 2 * 10.0**-places if places is not None else 0.0
    blocks = spark.createDataFrame([(i, max(1, -(-int(c) // BLOCK))) for i, c in enumerate(cells.count.tolist())], "cell int, blocks int")
    return held, _searches(asked, cells, k, slack, kind), F.broadcast(blocks), path


def searched_blocks(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", places: int | None = None) -> DataFrame:
    """``q, searched, blocks``: how many blocks each query is compared with, of how many."""
    _, searches, blocks, _ = _planned(queries, rows, id_col, vector, k, metric, places)
    total = blocks.agg(F.sum("blocks").alias("blocks"))
    return searches.join(blocks, "cell").groupBy(F.col("id").alias("q")).agg(F.sum("blocks").alias("searched")).crossJoin(F.broadcast(total))


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", places: int | None = None) -> DataFrame:
    """``q, id, d, rank``: the ``k`` rows nearest to each query, itself left out, ties by id.

    ``d`` is the squared Euclidean distance or, for ``cosine``, the similarity
    negated (0 where a vector is zero), rounded before ranking if ``places`` is
    given.  A task compares one block's rows with the queries sent to it and
    hands on ``k`` rows a query; a second step merges these.  Vectors are of
    one length and without nulls.
    """
    kind = dict(rows.dtypes)[id_col]
    held, searches, blocks, _ = _planned(queries, rows, id_col, vector, k, metric, places)
    own = held.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    sent = searches.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v")
    met = own.unionByName(sent).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "block").sortWithinPartitions("cell", "block", "side", "id")

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric == "euclidean":
            return np.stack([((b - x) ** 2).sum(1) for x in a])
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
        return -np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, piece, side = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if (cell[lo], piece[lo]) != now:
                    now, parts, block = (cell[lo], piece[lo]), [], None
                if side[lo] == 0:
                    parts.append((part.column(3), _vectors(part, 4)))
                    continue
                if not parts:
                    continue
                if block is None:
                    block = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                for start in range(0, part.num_rows, AT_ONCE):
                    some = part.slice(start, AT_ONCE)
                    d = distances(_vectors(some, 4), block[1])
                    d = d if places is None else np.round(d, places)
                    order = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
                    q = some.column(3).take(pa.array(np.repeat(np.arange(len(d)), order.shape[1])))
                    yield pa.RecordBatch.from_arrays([q, block[0].take(pa.array(order.ravel())), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["q", "id", "d"])

    found = met.mapInArrow(work, f"q {kind}, id {kind}, d double").where("q <> id")
    best = Window.partitionBy("q").orderBy("d", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
