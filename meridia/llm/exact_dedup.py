"""Exact deduplication by a heavy-hitter split.

A Misra-Gries pass (Spark's own ``freqItems`` aggregate, which is that
algorithm) proposes digests that more than ``support`` of all rows may carry.
An exact map-side-combined count verifies them.  The verified winners, at most
``1 / support`` rows, are broadcast and their rows are resolved where they
stand; no row is shuffled before that, and then only the remaining digests,
each under ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, clipped, free_names, small_side, staged


def normalised_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with each run of ASCII white space as one blank."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """Membership of every row in its group of equal texts.

    Columns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per
    input row.  A null text counts as empty.  The smallest id stays; null ids
    come after all others and stay only where a group has nothing else.  Of
    rows that repeat the same id and text exactly one stays.  An empty table
    gives an empty result.
    """
    if not 1e-4 <= support <= 1:
        raise ValueError("support must lie between 0.0001 and 1")
    rows = clipped(docs, id=id_col, text=text_col)
    rows = rows.select("id", F.unhex(normalised_digest(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "digests")

    total = rows.count()
    frequent = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    proposed = frequent.select(F.explode("digest_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    summary = (first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    winners = rows.join(F.broadcast(proposed), "digest", "left_semi").groupBy("digest").agg(*summary)
    winners = winners.where(F.col("group_size") > F.greatest(F.lit(1.0), F.lit(support * total)))
    winners = staged(winners, "heavy")  # at most 1 / support rows

    heavy = rows.join(F.broadcast(winners), "digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(*summary), "digest")
    return heavy.unionByName(light).select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Decisions are made on ids and digests; texts are then read once more, past
    the keys that go.  Of rows that repeat an id and a text one stays, whatever
    else they hold; null ids and null or empty texts are values like others,
    and an empty table gives an empty result.
    """
    id_name, digest = free_names(docs, "id", "digest")
    keys = exact_duplicates(docs, id_col, text_col, support)
    keys = keys.groupBy(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(digest)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    keys = staged(keys.where("not kept or copies > 1"), "gone")
    marked = docs.withColumn(digest, normalised_digest(docs[text_col]))

    def same(side: DataFrame):
        return marked[id_col].eqNullSafe(side[id_name]) & (marked[digest] == side[digest])

    gone, again = small_side(keys.select(id_name, digest)), small_side(keys.where("kept").select(id_name, digest))
    stay = marked.join(gone, same(gone), "left_anti")
    once = marked.join(again, same(again), "left_semi").dropDuplicates([id_col, digest])
    return stay.unionByName(once).drop(digest)
