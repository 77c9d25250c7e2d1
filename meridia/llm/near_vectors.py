"""Near-duplicate embeddings by cross-polytope hashing.

1. *Hash.*  A unit vector is rotated by three rounds of random signs and a fast
   Hadamard transform; its cross-polytope value is the coordinate of largest
   size, with its sign.  ``k`` values make a bucket of a table.  A vector is at
   home in one bucket of each table and probes the ones next in line.  ``k``
   follows the number of vectors, and the number of tables follows from the
   share of pairs at the threshold that one table finds, measured on random
   pairs, so that all tables miss at most one such pair in a hundred.
2. *Balls.*  Every bucket has its least vector for a hub.  A vector joins the
   least hub within half the threshold's angle, so any two vectors of a ball
   are linked and a group of copies counts its links without writing a pair.
3. *Verify.*  A bucket compares the centres of its balls.  By the triangle
   inequality two balls are linked throughout, not at all, or undecided; the
   members of undecided balls are compared in blocks, and only counts leave.
   Crowded buckets are cut into tiles of bounded size, none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clipped, discard, shuffle_parts, small_side, staged
from .components import connected_components

THRESHOLD = 0.9
#: Buckets a vector looks into in each table, its home included.
PROBES = 8
#: Share of pairs at the threshold that all tables together may miss, by the measured rate of one.
MISSES = 0.01
#: A table has at least this many buckets for each vector.
SPARE = 16
#: Rows that one side of a compared tile has on average.
TILE = 1000
#: Angles nearer to a bound than this are decided by comparing the vectors.
SLACK = 1e-6
_SEED = 20_011


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix over the root of its size, by the fast transform; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2)
        half *= 2
    return x.reshape(n, width) / math.sqrt(width)


def padded_width(dim: int) -> int:
    return max(4, 1 << (dim - 1).bit_length())


@lru_cache(maxsize=64)
def _signs(width: int, table: int, value: int) -> np.ndarray:
    rng = np.random.default_rng([_SEED, width, table, value])
    return rng.integers(0, 2, (3, width)) * 2.0 - 1.0


def polytope_codes(unit: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """Bucket codes of each row in one table: its home, then the ``probes - 1`` next in line.

    A next bucket replaces one value by one of its three runners-up, or two by
    their first runners-up, in order of the squared size that is given up.
    """
    n, dim = unit.shape
    width = padded_width(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    best, others, costs = [], [], []
    for value in range(k):
        y = padded
        for signs in _signs(width, table, value):
            y = hadamard(y * signs)
        size = np.abs(y)
        top = np.argpartition(-size, 3, axis=1)[:, :4]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        held = np.take_along_axis(y, top, 1)
        code = (top * 2 + (held < 0)).astype(np.uint64)
        place = np.uint64(pow(2 * width, k - 1 - value, 2**64))
        best.append(code[:, :1] * place)
        others.append(code[:, 1:] * place - best[-1])
        costs.append(np.abs(held[:, :1]) ** 2 - np.abs(held[:, 1:]) ** 2)
    home = sum(best)
    steps, cost = [np.zeros((n, 1), np.uint64), *others], [np.zeros((n, 1)), *costs]
    for i in range(k):
        for j in range(i + 1, k):
            steps.append(others[i][:, :1] + others[j][:, :1])
            cost.append(costs[i][:, :1] + costs[j][:, :1])
    order = np.argsort(np.hstack(cost), axis=1, kind="stable")[:, :probes]
    return home + np.take_along_axis(np.hstack(steps), order, 1)


@lru_cache(maxsize=64)
def plan_tables(n: int, dim: int, threshold: float, probes: int = PROBES, misses: float = MISSES) -> tuple[int, int]:
    """Values ``k`` of a bucket and the number of tables for ``n`` vectors."""
    width = padded_width(dim)
    k = max(1, math.ceil(math.log(max(2, SPARE * n)) / math.log(2 * width)))
    if dim == 1:
        return 1, 1
    rng = np.random.default_rng(_SEED)
    a = rng.standard_normal((2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(1 - threshold**2) * b
    x, y = polytope_codes(a, 0, k, probes), polytope_codes(b, 0, k, probes)
    met = ((x == y[:, :1]) | (y == x[:, :1])).any(1).mean()
    return k, max(1, math.ceil(math.log(misses) / math.log(min(0.999, max(1e-3, 1 - met))))) if met < 1 else 1


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever the scale of their finite entries."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, exact for small ones too."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(-1)) / 2))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite, and one other than zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def hashed_vectors(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """``row, vec_id, unit, homes, probes``: packed unit vector and its buckets over all tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).cast(pa.list_(pa.float64()))
            lengths = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                unit = unit_vectors(vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim))
                k, tables = plan_tables(n, dim, threshold)
                salt = np.array([[t * 0x9E3779B97F4A7C15 + dim * 0xD1342543DE82EF95 & 2**64 - 1 for t in range(tables)]], np.uint64)
                codes = np.stack([polytope_codes(unit, t, k, PROBES) for t in range(tables)], 1) + salt[:, :, None]
                codes = codes.view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)), pa.array(c.ravel())) for c in (codes[:, :, 0], codes[:, :, 1:].reshape(len(at), -1))]
                packed = pa.array([u.tobytes() for u in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in (0, 1)] + [packed, *lists], names=names)

    names = ["row", "vec_id", "unit", "homes", "probes"]
    fields = rows.select("row", "vec_id").schema.add("unit", T.BinaryType()).add("homes", T.ArrayType(T.LongType())).add("probes", T.ArrayType(T.LongType()))
    return rows.mapInArrow(work, fields)


def balls(hashed: DataFrame, threshold: float) -> DataFrame:
    """``row, ball, alpha`` of vectors that join a hub: the hub's row and the angle to it, at most half the threshold's."""
    homes = hashed.select("row", F.explode("homes").alias("bucket"))
    hubs = homes.groupBy("bucket").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = staged(homes.join(hubs, "bucket").where("row <> hub").select("row", "hub").distinct(), "hubs")
    units = hashed.select("row", "unit")
    centres = small_side(pairs.select("hub").distinct().join(units.withColumnsRenamed({"row": "hub", "unit": "centre"}), "hub"), 20_000)
    met = pairs.join(units, "row").join(centres, "hub").where("length(unit) = length(centre)").select("row", "hub", "unit", "centre")
    most = math.acos(threshold) / 2 - SLACK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(i).to_pylist() for i in (2, 3))
                alpha = np.array([angle(np.frombuffer(x), np.frombuffer(y)) for x, y in zip(a, b)])
                near = pa.array(alpha <= most)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alpha)], names=["row", "hub", "alpha"]).filter(near)

    near = met.mapInArrow(work, "row long, hub long, alpha double")
    joined = staged(near.groupBy("row").agg(F.min(F.struct("hub", "alpha")).alias("best")).select("row", "best.*").withColumnRenamed("hub", "ball"), "balls")
    discard(pairs)
    return joined


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray | list]]]:
    """Columns after the first ``keys`` of one run of equal keys after another, from sorted batches."""
    now, held = None, []

    def joined():
        return now, [[x for part in held for x in part[i]] for i in range(len(held[0]))]

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        names = list(zip(*columns[:keys]))
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                if names[start] != now and held:
                    yield joined()
                    held = []
                now = names[start]
                held.append([c[start:i] for c in columns[keys:]])
                start = i
    if held:
        yield joined()


def ball_pairs(members: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """``a, b, certain``: balls of one bucket that are linked throughout, or undecided; ``a < b``.

    ``members`` is ``bucket, ball, home``, each ball once a bucket.  Two balls
    are compared where one of them has a member at home in the bucket.  A
    bucket of more than ``TILE`` balls is cut by a hash of the ball, and every
    two cuts meet in a tile.
    """
    cuts = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("ball", F.lit(3)), F.col("cuts")).cast("int")
    tiles = members.join(cuts, "bucket").withColumn("cut", cut).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tiles = tiles.select("bucket", F.least("cut", "other").alias("lo"), F.greatest("cut", "other").alias("hi"), "cut", "ball", "home").join(centres, "ball")
    tiles = tiles.select("bucket", "lo", "hi", "cut", "ball", "home", "reach", "unit")
    parts = shuffle_parts(members.sparkSession)
    tiles = tiles.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    theta = math.acos(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, lo, hi), (cut, ball, home, reach, unit) in _groups(batches, 3):
            for dim in {len(u) for u in unit}:
                at = [i for i, u in enumerate(unit) if len(u) == dim]
                if len(at) < 2:
                    continue
                x = np.frombuffer(b"".join(unit[i] for i in at)).reshape(len(at), -1)
                names, homes, far, side = (np.array([c[i] for i in at]) for c in (ball, home, reach, cut))
                for i in range(len(at) - 1):
                    later = slice(i + 1, None)
                    cosine = x[later] @ x[i]
                    wide = far[later] + far[i]
                    able = (cosine >= np.where(wide == 0, threshold, np.cos(np.minimum(math.pi, theta + wide + SLACK)))) & ((homes[later] | homes[i]) > 0)
                    if lo != hi:
                        able &= side[later] != side[i]
                    for j in np.flatnonzero(able).tolist():
                        sure = wide[j] == 0 or float(angle(x[i], x[i + 1 + j])) + wide[j] <= theta - SLACK
                        a, b = int(names[i]), int(names[i + 1 + j])
                        out.append((min(a, b), max(a, b), bool(sure)))
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return tiles.mapInArrow(work, "a long, b long, certain boolean").distinct()


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "certain"])


def undecided_counts(pairs: DataFrame, placed: DataFrame, sizes: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """``row, a, b, links``: how many vectors of the other ball a vector of an undecided pair is linked with, where any."""
    blocks = sizes.select("ball", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    cut = lambda n: F.pmod(F.xxhash64("row", F.lit(5)), F.col(n)).cast("int")
    pairs = pairs.join(blocks.withColumnsRenamed({"ball": "a", "blocks": "na"}), "a").join(blocks.withColumnsRenamed({"ball": "b", "blocks": "nb"}), "b")
    sides = []
    for own, other, side in (("a", "b", 0), ("b", "a", 1)):
        met = pairs.join(placed.select(F.col("ball").alias(own), "row"), own)
        met = met.withColumn("own", cut(f"n{own}")).withColumn("across", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        sides.append(met.select("a", "b", F.col("own" if side == 0 else "across").alias("i"), F.col("across" if side == 0 else "own").alias("j"), F.lit(side).alias("side"), "row"))
    rows = sides[0].unionByName(sides[1]).join(units, "row").select("a", "b", "i", "j", "side", "row", "unit")
    rows = rows.repartition(shuffle_parts(pairs.sparkSession), "a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b, _, _), (side, row, unit) in _groups(batches, 4):
            x = np.frombuffer(b"".join(unit)).reshape(len(unit), -1)
            side, row = np.array(side), np.array(row)
            linked = x[side == 0] @ x[side == 1].T >= threshold
            names, counts = np.concatenate([row[side == 0], row[side == 1]]), np.concatenate([linked.sum(1), linked.sum(0)])
            names, counts = names[counts > 0], counts[counts > 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (names, np.full(len(names), a), np.full(len(names), b), counts)], names=["row", "a", "b", "links"])

    return rows.mapInArrow(work, "row long, a long, b long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors are linked when their cosine reaches ``threshold``, which must be
    between 0 and 1.  Null and empty vectors, those of zeros and those with a
    null or non-finite entry link with nothing, nor do vectors of different
    lengths with each other.  Every row counts as a vector of its own, also
    where rows or ids repeat.  ``component_id`` is the smallest id that links
    reach, the row's own included; a null id takes part but names a component
    only where it has no other id, and such a row counts as kept.  An empty
    table gives an empty result.
    """
    rows = clipped(vectors, vec_id=id_col, vector=vector_col)
    able = rows.where(usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "vector")
    alone = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    hashed = staged(hashed_vectors(able, able.count(), threshold), "hashed")
    units = hashed.select("row", "unit")

    joined = balls(hashed, threshold)
    placed = hashed.select("row", "vec_id", "homes", "probes").join(joined, "row", "left")
    placed = staged(placed.withColumn("ball", F.coalesce("ball", "row")).withColumn("alpha", F.coalesce("alpha", F.lit(0.0))), "placed")
    sizes = staged(placed.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), F.max("alpha").alias("reach"), F.min("vec_id").alias("least")), "sizes")

    looked = placed.select("ball", F.explode("homes").alias("bucket"), F.lit(1).alias("home")).unionByName(placed.select("ball", F.explode("probes").alias("bucket"), F.lit(0).alias("home")))
    shared = looked.groupBy("bucket").agg(F.min("ball").alias("a"), F.max("ball").alias("b"), F.max("home").alias("home")).where("a <> b and home = 1").select("bucket")
    members = staged(looked.join(shared, "bucket").groupBy("bucket", "ball").agg(F.max("home").alias("home")), "members")
    centres = sizes.select("ball", "reach").join(units.withColumnRenamed("row", "ball"), "ball")
    pairs = staged(ball_pairs(members, centres, threshold), "pairs")
    discard(members)

    counted = staged(undecided_counts(pairs.where("not certain").select("a", "b"), placed, sizes, units, threshold), "counted")
    sure = pairs.where("certain").select("a", "b")
    edges = sure.unionByName(counted.select("a", "b").distinct())
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = both.join(sizes.select(F.col("ball").alias("b"), "size"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("size").alias("across"))
    labels = connected_components(edges)
    named = sizes.join(labels.withColumnRenamed("node", "ball"), "ball", "left").withColumn("label", F.coalesce("label", "ball"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").join(across, "ball", "left").select("ball", "component_id", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("links"))

    more = counted.groupBy("row").agg(F.sum("links").alias("more"))
    found = placed.select("row", "vec_id", "ball").join(named, "ball").join(more, "row", "left")
    found = found.select("vec_id", (F.col("links") + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    discard(joined)
    return found.unionByName(alone)
