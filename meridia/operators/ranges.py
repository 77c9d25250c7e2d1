"""Running totals over one order of a whole table, without a task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch_path

#: Rows a range holds on average, sampled keys a boundary is chosen from, and ranges at most (longer ones then).
ROWS_PER_RANGE, KEYS_PER_RANGE, MOST_RANGES = 50_000, 50, 10_000
#: Totals of ranges and groups that a join may broadcast.
SMALL = 1_000_000


def range_of(df: DataFrame, keys: list[str]) -> Column | None:
    """Number of the range of ``keys`` (ascending) a row falls into, None if there is one only; ranges follow each other in key order.

    Boundaries come from a hash sample of the keys whose size depends on the
    number of ranges only, so ranges are near even and rows with equal keys
    share one.
    """
    n = df.count()
    ranges = min(-(-n // ROWS_PER_RANGE), MOST_RANGES)
    if ranges < 2:
        return None
    every = max(1, n // (ranges * KEYS_PER_RANGE))
    sample = df.where(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).select(*keys).orderBy(*keys).collect()
    cuts = sample[KEYS_PER_RANGE :: KEYS_PER_RANGE] if every > 1 else sample[:: max(1, len(sample) // ranges)][1:]
    types = dict(df.dtypes)
    cuts = [F.struct(*[F.lit(row[k]).cast(types[k]).alias(k) for k in keys]) for row in cuts]
    if not cuts:
        return None
    key = F.struct(*keys)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.array(*[g[0] for g in groups]), lambda c: c <= key))
    fine = F.element_at(F.array(*[F.array(*g) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda c: c <= key))).cast("int")


def running_totals(df: DataFrame, by: list[str], keys: list[str], sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """``df`` with, for every ``column: name`` of ``sums``, the column's total over the rows of its group up to this one.

    The order is that of ``keys``, ascending, which should tell the rows of a
    group apart.  Spark deals the rows into ranges of the keys; totals per range
    come first, then each range is added up inside: a group of any size spreads
    over as many tasks as it has ranges.  The input is written once as it is
    counted, and once more with its ranges; their totals are broadcast where
    they are few.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "running")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    until = Window.currentRow if inclusive else -1
    ranges = min(-(-df.count() // ROWS_PER_RANGE), MOST_RANGES)
    if ranges < 2:
        whole = Window.partitionBy(*by or [F.lit(0)]).orderBy(*keys).rowsBetween(Window.unboundedPreceding, until)
        return df.select(*df.columns, *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(n) for c, n in sums.items()])
    placed, dealt = scratch_path(spark, "ranges"), df.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(placed)
    placed = spark.read.schema(dealt.schema).parquet(placed)
    remove(spark, path)
    totals = placed.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{n}") for c, n in sums.items()])
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__t_{n}") for n in sums.values()])
    summed = scratch_path(spark, "totals")
    totals.write.parquet(summed)
    totals = spark.read.schema(totals.schema).parquet(summed)
    totals = F.broadcast(totals) if totals.count() <= SMALL else totals
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    inside = Window.partitionBy(*by, "__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, until)
    joined = placed.join(totals, same)
    return joined.select(*df.columns, *[(F.col(f"__t_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for c, n in sums.items()])
