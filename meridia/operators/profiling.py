"""Dataset profiles: distributions, correlations, co-occurrence, word counts, verification."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dataset_stats(df: DataFrame, label: str, subtypes: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"), *[F.sum(c).alias(c) for c in subtypes])


def composition(df: DataFrame, label: str, least: int = 5000) -> DataFrame:
    """Whether both classes occur and the table is large enough."""
    both = F.coalesce(F.bool_or(F.col(label) == 1), F.lit(False)) & F.coalesce(F.bool_or(F.col(label) == 0), F.lit(False))
    return df.agg(both.alias("complete"), (F.count(F.lit(1)) >= least).alias("large_enough"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Value counts, null included, with their share in percent."""
    counts = df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", F.col("count") * 100.0 / total)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs, each over the rows where both are known; NaN counts as unknown."""
    if len(columns) < 2:
        raise ValueError("two numeric columns at least")
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    wide = clean.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def cooccurrence(df: DataFrame, labels: list[str]) -> DataFrame:
    """``a, b, both, given_a``: counts of label pairs and P(b | a), 0 where a never occurs."""
    cells = [(a, b) for a in labels for b in labels]
    wide = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in cells])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"{a}__{b}"), F.lit(0)).alias("both"), F.col(f"{a}__{a}").alias("own")) for a, b in cells]
    out = wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return out.select("a", "b", "both", F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("own").cast("double")), F.lit(0.0)).alias("given_a"))


def active_count_histogram(df: DataFrame, labels: list[str]) -> DataFrame:
    """How many rows have 0, 1, .. all labels, empty bins included."""
    active = sum((F.col(c) for c in labels[1:]), F.col(labels[0])).cast("int")
    counts = df.groupBy(active.alias("active")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(labels) + 1).select(F.col("id").cast("int").alias("active"))
    return bins.join(F.broadcast(counts), "active", "left").select("active", F.coalesce("n", F.lit(0)).alias("n"))


def inconsistencies(df: DataFrame, label: str, subtypes: list[str]) -> DataFrame:
    """Positives without a sub-label, negatives with one."""
    some = F.greatest(F.lit(0), *[F.coalesce(F.col(c), F.lit(0)) for c in subtypes]) == 1
    return df.agg(F.count_if((F.col(label) == 1) & ~some).alias("positive_without"), F.count_if((F.col(label) == 0) & some).alias("negative_with"))


def word_counts(df: DataFrame, words: str, by: list[str], least: int = 1) -> DataFrame:
    counts = df.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


def verify(df: DataFrame, required: list[str], domains: dict[str, list], expected: int | None, id_col: str) -> DataFrame:
    """One row: row count, missing fields, values outside their domain, the first five bad ids, verdict.

    Ids compare as text; ``bad_ids`` holds those of up to five bad rows, the
    smallest first, null ids left out.  Columns the table lacks altogether are
    named in ``missing_columns``.
    """
    absent = [c for c in required if c not in df.columns]
    here = [c for c in required if c in df.columns]
    empty = F.lit(False)
    for c in here:
        empty = empty | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    outside = F.lit(False)
    for c, values in domains.items():
        if c in df.columns:
            outside = outside | ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    marked = df.select(F.col(id_col).cast("string").alias("id"), empty.alias("empty"), outside.alias("outside"))
    out = marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("empty").alias("n_missing"), F.count_if("outside").alias("n_outside"), F.min(F.when(F.col("empty") | F.col("outside"), F.col("id"))).alias("first_bad_id"))
    bad = marked.where((F.col("empty") | F.col("outside")) & F.col("id").isNotNull()).orderBy("id").limit(5)
    out = out.crossJoin(F.broadcast(bad.agg(F.sort_array(F.collect_list("id")).alias("bad_ids"))))  # one row each
    ok = (F.col("n_missing") == 0) & (F.col("n_outside") == 0) & F.lit(not absent)
    if expected is not None:
        ok = ok & (F.col("n_rows") == expected)
    return out.withColumns({"missing_columns": F.lit(",".join(absent)), "valid": ok})


def category_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Counts of fixed keys, zeros included, others ignored, with presence."""
    grid = df.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))
