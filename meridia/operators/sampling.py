"""Deterministic samplers: hash order, never partitioning, decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import hash_order


def check_seed(seed: int) -> int:
    if seed < 0:
        raise ValueError("a seed isn't negative")
    return seed


def balanced_sample(df: DataFrame, id_col: str, category: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows spread evenly over the categories that occur.

    The first ``n % k`` categories in order take one more.  A category with
    fewer rows than its quota repeats them in turn.  An empty table stays empty.
    Null is a category.  Rows are counted per prefix of the hash, and only the
    prefixes that can hold the quota are ranked.
    """
    check_seed(seed)
    d = df.withColumn("__h", hash_order(id_col, seed)).withColumn("__p", F.substring("__h", 1, 3))
    prefixes = d.groupBy(category, "__p").agg(F.count(F.lit(1)).alias("__n"))
    counts = prefixes.groupBy(category).agg(F.sum("__n").alias("__rows"))
    w = Window.partitionBy(F.lit(0))
    k, place = F.count(F.lit(1)).over(w), F.row_number().over(Window.orderBy(category))
    quota = F.floor(F.lit(n) / k) + (place <= F.lit(n) % k).cast("int")
    quotas = counts.select(category, "__rows", quota.cast("int").alias("__quota"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(category).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefixes = prefixes.select(F.col(category).alias("__c"), "__p", before.alias("__before"))
    held = prefixes.join(F.broadcast(quotas), F.col("__c").eqNullSafe(F.col(category))).where("__before < __quota").select("__c", F.col("__p").alias("__q"), "__before", "__rows", "__quota")
    ranked = d.join(F.broadcast(held), F.col(category).eqNullSafe(F.col("__c")) & F.col("__p").eqNullSafe(F.col("__q")))
    k = F.row_number().over(Window.partitionBy(category, "__p").orderBy("__h", id_col))
    ranked = ranked.withColumn("__k", F.col("__before") + k)
    times = F.floor(F.col("__quota") / F.col("__rows")) + (F.col("__k") <= F.col("__quota") % F.col("__rows")).cast("int")
    out = ranked.withColumn("__times", times.cast("int")).where("__times > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*df.columns, "copy")


def weighted_sample(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42, rows_per_leaf: int = 20_000) -> DataFrame:
    """``n`` draws with replacement, proportional to weight; column ``draw``.

    Rows lie on a line, each as long as its weight, in order of hash prefix and
    id.  A draw descends by two hex digits a level, each time into the one of
    at most 256 children that its point lies in, and meets the rows of its leaf
    only.  Rows without a positive weight are never drawn; an empty table gives
    no draw.
    """
    check_seed(seed)
    d = df.where(F.col(weight) > 0).withColumn("__h", hash_order(id_col, seed)).withColumn("__w", F.col(weight).cast("double"))
    levels, rows = 1, d.count()
    while 256**levels * rows_per_leaf < rows:
        levels += 1
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw")), 1, 13), 16, 10).cast("double") / float(2**52)
    total = F.broadcast(d.agg(F.sum("__w").alias("__total")))
    at = df.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("__u")).crossJoin(total).select("draw", F.lit("").alias("__p"), (F.col("__u") * F.col("__total")).alias("__at"))

    def spans(parts: DataFrame, order: str) -> DataFrame:
        """From and to of each part within its parent; the last one has no end, so every point lies in a part."""
        upto = Window.partitionBy("__p").orderBy(order)
        to = F.sum("__w").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        parts = parts.withColumn("__to", to)
        last = F.lead(F.lit(1)).over(upto).isNull()
        return parts.withColumn("__from", F.lag("__to", 1, 0.0).over(upto)).withColumn("__to", F.when(last, F.lit(float("inf"))).otherwise(F.col("__to")))

    inside = (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))
    for k in range(1, levels + 1):
        parts = d.groupBy(F.substring("__h", 1, 2 * k).alias("__c")).agg(F.sum("__w").alias("__w")).withColumn("__p", F.substring("__c", 1, 2 * k - 2))
        at = at.join(spans(parts, "__c"), "__p").where(inside).select("draw", F.col("__c").alias("__p"), (F.col("__at") - F.col("__from")).alias("__at"))
    leaves = spans(d.withColumn("__p", F.substring("__h", 1, 2 * levels)), id_col)
    return leaves.join(at, "__p").where(inside).select(*df.columns, "draw")
