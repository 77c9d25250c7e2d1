"""Shared helpers: intermediate tables, ordered buckets, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular-expression class body.
SPACE = r"\x20\x09-\x0D"

_LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset
    (tests on one machine) a local temporary folder is made and recorded.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meridia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage, so what follows neither recomputes the text pass nor
    depends on executors that may be lost.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; any other table is left alone."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jvm = spark._jvm.org.apache.hadoop.fs
        table = jvm.Path(file).getParent()
        if table.getParent().getName() == jvm.Path(shared_folder(spark)).getName() and re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", table.getName()):
            table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A side of a join, marked for broadcast where its counted rows are at most ``most``; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and all else unchanged; null is empty."""
    return b"" if text is None else text.encode().translate(_LOWER_AZ)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def clipped(docs: DataFrame, **columns: str) -> DataFrame:
    """Select ``name=source column`` pairs only."""
    return docs.select(*[docs[c].alias(n) for n, c in columns.items()])


def arrow_rows(batch: pa.RecordBatch, *names: str):
    """Iterate one Arrow batch as tuples without building all rows at once."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in cols)


def range_boundaries(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` existing values that cut ``column`` evenly.

    ``percentile_approx`` returns values of the column itself, so each
    boundary is the first value of its range.
    """
    if parts < 2:
        return []
    points = [i / parts for i in range(1, parts)]
    row = df.agg(
        F.percentile_approx(F.col(column), F.array(*map(F.lit, points)), F.lit(max(10_000, 20 * parts))).alias("p"),
        F.min(column).alias("least"),
    ).first()
    return sorted(set(row["p"] or []) - {row["least"]})


def range_bucket(value: Column, boundaries: list) -> Column:
    """Index of the range ``value`` falls into; nulls go to range 0.

    Two short scans (coarse, then fine) instead of one over all boundaries.
    """
    if not boundaries:
        return F.lit(0)
    step = max(1, int(len(boundaries) ** 0.5))
    groups = [boundaries[i : i + step] for i in range(0, len(boundaries), step)]
    heads = F.lit([g[0] for g in groups])
    coarse = F.size(F.filter(heads, lambda b: b <= value))
    fine = F.element_at(F.lit(groups), F.greatest(coarse, F.lit(1)))
    within = F.size(F.filter(fine, lambda b: b <= value))
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + within).cast("int")


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in the order of an id, nulls first, and of a tie within an id.

    ``own`` is a row's range from 0, ``opens`` whether its id and tie are those
    its range begins with (never in the first), ``first`` whether they are the
    least of all.
    """

    own: Column
    opens: Column
    first: Column
    count: int


def ordered_ranges(rows: DataFrame, id_col: str, tie: Column, parts: int) -> Ranges:
    """About ``parts`` even ranges; an id that fills several of them, the null one too, is cut by its tie.

    ``tie`` is a 64-bit hash.  Ids that fill a range are those that quantiles
    name twice, so they are fewer than ``parts``, and only their ties are
    looked at a second time.
    """
    value, points = F.col(id_col), [i / parts for i in range(1, parts)]
    tie = F.shiftright(tie, 11)  # quantiles are exact up to 53 bits
    accuracy = F.lit(max(10_000, 20 * parts))
    whole = rows.agg(
        F.percentile_approx(value, F.array(*map(F.lit, points or [0.5])), accuracy).alias("p"), F.min(value).alias("least"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(value.isNull(), 1)).alias("nulls"),
    ).first()
    named = Counter(whole["p"] or [] if points else [])
    bounds = sorted(set(named) - {whole["least"]})
    cuts = {v: n for v, n in named.items() if n > 1}
    if whole["nulls"] and parts > 1:
        cuts[None] = max(1, round(parts * whole["nulls"] / whole["n"]))
    ties: dict = {}
    if cuts:
        wide = value.isNull() if None in cuts else F.lit(False)
        wide = wide | value.isin([v for v in cuts if v is not None]) if set(cuts) - {None} else wide
        for r in rows.where(wide).groupBy(id_col).agg(F.percentile_approx(tie, F.array(*map(F.lit, points)), accuracy).alias("p"), F.min(tie).alias("least")).collect():
            k = min(cuts[r[id_col]], parts)
            picked = {r["p"][len(points) * i // k] for i in range(1, k)} - {r["least"]}
            ties[r[id_col]] = r["least"], sorted(picked)
    own, opens = range_bucket(value, bounds), value.isin(bounds) if bounds else F.lit(False)
    first = value.isNull() if whole["nulls"] else value.eqNullSafe(F.lit(whole["least"]))
    if whole["nulls"] and None in ties:
        first = first & (tie == F.lit(ties[None][0]))
    elif whole["least"] in ties:
        first = first & (tie == F.lit(ties[whole["least"]][0]))
    for v, (least, inner) in ties.items():
        here = value.eqNullSafe(F.lit(v))
        after = value.isNotNull() if v is None else F.coalesce(value > F.lit(v), F.lit(False))
        own = own + F.when(here, range_bucket(tie, inner)).when(after, F.lit(len(inner))).otherwise(F.lit(0))
        starts = [*inner, *([least] if v in bounds else [])]
        opens = F.when(here, tie.isin(starts) if starts else F.lit(False)).otherwise(opens)
    return Ranges(own.cast("int"), F.coalesce(opens, F.lit(False)), F.coalesce(first, F.lit(False)), len(bounds) + sum(len(i) for _, i in ties.values()) + 1)
