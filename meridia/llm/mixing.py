"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w`` from a hash of its id and
text and its quality weight; within a source the smallest keys come first, and a prefix
sum of sizes in that order fills the source's budget.  Complete epochs precede
the fractional selection.  The order within a source is cut into key ranges of
about ``rows_per_range`` documents: prefix sums run over the ranges' totals and
then inside each range, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, clipped, free_names, small_side, staged


def count_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """``-ln(u) / w`` with u in (0, 1] from the md5 of seed, id and the text's md5, so rows of one id spread, too."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(name), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """Budgets per source: ``source_key, source, source_size, n_rows, target``.

    ``sizes`` has one row per source.  Sources in code-point order, null last,
    weigh 1 .. ``cycle`` in turn and share the sum of all sizes; a target stops
    at ``cap`` times its source's size and the excess is shared again by
    weight.  That fixed point is a water level: targets are
    ``min(cap * size, weight * level)``.  With sources in order of the level at
    which each is full, every suffix gives a level for its sources if all
    before are full; of those none of its sources is above, the highest holds.
    A null source is one like others, a source of size 0 gets 0, and no source
    gives no row.  Sources, one row each, pass one window: they are thousands,
    not a host each.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % cycle + 1).cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("full", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.col("full")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole))
    return s.select("source_key", "source", "source_size", "n_rows", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    seed: int = 7,
    cycle: int = 3,
    cap: float = 3.0,
    rows_per_range: int = 10_000,
    with_hash: bool = False,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``quality`` (columns ``doc_id, weight``, weights at least 1) biases the
    fractional selection; documents it lacks weigh 1.  Returns ``doc_id, source,
    size, source_size, target, taken``, one row per input row.  The budget of a
    source is its target rounded to words; the document at the budget's edge is
    taken in part.  Null text has size 0 and takes 0, a null source is a source
    of its own, repeated rows count separately (ties fall by id and size; rows
    that share an id, the null one too, have keys of their own unless their
    texts are equal), and an empty table gives an empty result.  ``with_hash``
    adds ``text_hash``, which tells the texts of an id apart.
    """
    rows = clipped(docs, id=id_col, text=text_col, source=source_col)
    rows = rows.select("id", "source", count_words(F.col("text")).alias("size"), exponential_key(F.col("id"), F.col("text"), F.lit(1.0), seed).alias("plain"), F.xxhash64("text").alias("text_hash"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        extra = quality.groupBy(F.col("doc_id").alias("id")).agg(F.greatest(F.lit(1.0), F.max("weight").cast("double")).alias("weight"))
        rows = rows.join(extra, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = rows.select(
        "id", "source", "size", "text_hash",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("source_key"),
        (F.col("plain") / F.col("weight")).alias("key"),
    )
    rows = staged(rows, "sizes")

    sizes = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goals = source_targets(sizes, cycle, cap)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr(f"floor(target + 0.5) div source_size")).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    goals = goals.withColumn("ranges", F.ceil(F.col("n_rows") / rows_per_range)).drop("source", "n_rows")
    goals = staged(goals, "targets")

    # Keys of weights of at least 1 put at most weight * n / ranges rows into a range.
    placed = rows.join(goals, "source_key")
    place = F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges"))
    placed = placed.withColumn("range", F.least(place, F.col("ranges") - 1))
    totals = placed.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    up_to = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_key", "range", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_key", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(totals, ["source_key", "range"]).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    return placed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *(["text_hash"] if with_hash else []),
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """Quality label 1 weighs 2, label 0 weighs 1, no label 1.5."""
    weight = F.when(F.col("quality") == 1, F.lit(2.0)).when(F.col("quality") == 0, F.lit(1.0)).otherwise(F.lit(1.5))
    return labels.select("doc_id", weight.alias("weight"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: whole documents, repeated once per copy taken, all columns.

    A document is repeated ``round(taken / size)`` times, so complete epochs
    repeat and the document at a budget's edge is in when at least half of it
    is.  Documents without a word, null texts too, take no part.  Copies are
    decided on ids, text hashes and sizes; the texts then meet them in one
    join, so rows that share an id, the null one too, are told apart by their
    texts.  Rows that share both share their copies evenly, some of them taking
    the remainder.  An empty table gives an empty result.
    """
    key, n, rows, text, share = free_names(docs, "id", "copies", "rows", "text_hash", "share")
    taken = mix_sources(docs, id_col, text_col, source_col, with_hash=True, **options)
    copies = taken.where("size > 0").groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias(n), F.count(F.lit(1)).alias(rows))
    copies = staged(copies.where(F.col(n) > 0), "copies")
    here = docs.where(count_words(docs[text_col]) > 0)

    def met(side: DataFrame) -> DataFrame:
        side = small_side(side)
        return here.join(side, here[id_col].eqNullSafe(side[key]) & (F.xxhash64(here[text_col]) == side[text]))

    single = met(copies.where(F.col(rows) == 1)).withColumn(share, F.col(n).cast("int"))
    nth = F.row_number().over(Window.partitionBy(key, text).orderBy(F.lit(0)))
    several = met(copies.where(F.col(rows) > 1))
    several = several.withColumn(share, F.floor((F.col(n) + F.col(rows) - nth) / F.col(rows)).cast("int")).where(F.col(share) > 0)
    both = single.unionByName(several)
    return both.withColumn(share, F.explode(F.sequence(F.lit(1), F.col(share)))).select(*[F.col(f"`{c}`") for c in docs.columns])
