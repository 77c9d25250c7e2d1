"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the least node reachable, for every node that has an edge.

    Each round a node takes the least label among itself and its neighbours,
    then its label's label, so long chains halve every round.  Every round is
    written to the shared folder, the one before it deleted, and ends as soon
    as no label changes.  A hub's neighbours meet its label in a skewed join,
    which Spark's adaptive execution splits.  Repeated edges, edges of a node
    with itself or with null count for nothing; without edges there is no row.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both = staged(both.where("node <> other").distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    last = labels
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = staged(new, "labels")
        discard(last)
        last, labels = new, new.select("node", "label")
        if new.where("label <> old").isEmpty():
            discard(both)
            return labels
