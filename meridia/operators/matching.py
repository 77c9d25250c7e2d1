"""Fuzzy matching of names to a bibliography through shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_year, title_tokens
from ..sources.scratch import scratch_path

#: A token that more right rows than this hold is common: its list is never joined row by row.
COMMON = 1_000
#: Least score of a match, and what an equal year and a surname add.
LEAST, YEAR, SURNAME = 0.1, 0.2, 0.2


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _score(shared: Column, year: Column, author: Column) -> Column:
    bonus = F.when(year, YEAR).otherwise(0.0) + F.when(author, SURNAME).otherwise(0.0)
    return shared / (F.col("ln") + F.col("rn") - shared) + bonus


def _best(pairs: DataFrame, *by: str) -> DataFrame:
    """Of each group the pair of highest score, the smaller right id on ties."""
    best = pairs.groupBy(*by).agg(F.min_by(F.struct("r", "score", "shared"), F.struct(-F.round("score", 12), F.col("r"))).alias("b"))
    return best.select(*by, "b.*")


def _common_tokens(rows: DataFrame, row: str, tokens: str, common: DataFrame) -> DataFrame:
    """``row, common``: the common tokens of a row, sorted, of rows that have any."""
    held = rows.select(row, F.explode(tokens).alias("w")).join(common, "w")
    return held.groupBy(row).agg(F.sort_array(F.collect_set("w")).alias("common"))


def fuzzy_best_match(
    left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, right_year: str | None = None, right_author: str | None = None, common: int = COMMON
) -> DataFrame:
    """Best right row per left row by token Jaccard, +0.2 for an equal year, +0.2 for the author's surname in the text.

    Column ``basis`` is ``overlap`` from 0.15 with two shared tokens and
    ``fallback`` from 0.1 with one; below that a row has no match.  Ties fall to
    the smaller right id.

    Pairs that share a token of at most ``common`` right rows come from an
    equi-join on these tokens.  Pairs that share common tokens only score at
    most the row's share of common tokens plus the bonuses; a left row whose
    bound doesn't reach its best score so far needs none of them.  For the
    others right rows are first folded to one row, the smallest id, for every
    set of common tokens, size and year (and surname, where it is looked up in
    the text), and left rows likewise, so no list of a common token is joined
    whole.
    """
    year = F.col(right_year).cast("string") if right_year else first_year(F.col(right_text))
    author = F.nullif(F.lower(F.col(right_author)), F.lit("")) if right_author else F.lit(None).cast("string")
    lefts = left.select(F.col(left_id).alias("l"), F.lower(left_text).alias("lt"), title_tokens(F.col(left_text)).alias("lk"), first_year(F.col(left_text)).alias("ly"))
    rights = right.select(F.col(right_id).alias("r"), title_tokens(F.col(right_text)).alias("rk"), year.alias("ry"), author.alias("ra"))
    lefts, rights = _staged(lefts.withColumn("ln", F.size("lk")), "lefts"), _staged(rights.withColumn("rn", F.size("rk")), "rights")
    counts = _staged(rights.select(F.explode("rk").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "tokens")
    often = counts.where(F.col("n") > common).select("w")

    rare = rights.select("r", F.explode("rk").alias("w")).join(counts.where(F.col("n") <= common).select("w"), "w")
    pairs = lefts.select("l", F.explode("lk").alias("w")).join(rare, "w").select("l", "r").distinct()
    full = pairs.join(lefts, "l").join(rights, "r").withColumn("shared", F.size(F.array_intersect("lk", "rk")).cast("long"))
    full = full.withColumn("score", _score(F.col("shared"), F.col("ly") == F.col("ry"), F.contains("lt", "ra")))
    first = _staged(_best(full, "l"), "first")

    bound = F.size("common") / F.col("ln") + F.when(F.col("ly").isNotNull(), YEAR).otherwise(0.0) + (SURNAME if right_author else 0.0)
    open_ = _common_tokens(lefts, "l", "lk", often).join(lefts.drop("lk"), "l").join(first.select("l", F.col("score").alias("so_far")), "l", "left")
    open_ = _staged(open_.where(bound >= F.greatest(F.lit(LEAST), F.coalesce("so_far", F.lit(0.0))) - 1e-9), "open")
    folded = _staged(_common_tokens(rights, "r", "rk", often).join(rights.drop("rk"), "r").groupBy(F.col("common").alias("theirs"), "rn", "ry", "ra").agg(F.min("r").alias("r")), "folded")

    alike = ["common", "ln", "ly"]
    ours = open_.select(*alike).distinct()
    theirs = folded.groupBy("theirs", "rn", "ry").agg(F.min("r").alias("r"))
    shared = F.size(F.array_intersect("common", "theirs")).cast("long")
    met = ours.withColumn("w", F.explode("common")).join(theirs.withColumn("w", F.explode("theirs")), "w").drop("w").distinct()
    met = met.withColumn("shared", shared).withColumn("score", _score(F.col("shared"), F.col("ly") == F.col("ry"), F.lit(False)))
    best = _best(met, *alike).withColumnsRenamed({c: f"{c}_" for c in alike})
    same = F.lit(True)
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = first.unionByName(open_.join(best, same).select("l", "r", "score", "shared"))

    if right_author:
        # Every stretch of a text that is as long as some surname is looked up among the surnames.
        surnames = folded.where("ra is not null")
        sizes = surnames.select(F.length("ra").alias("size")).distinct()
        parts = open_.crossJoin(F.broadcast(sizes)).where(F.length("lt") >= F.col("size"))  # a row for each length of a surname
        parts = parts.withColumn("ra", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("lt") - F.col("size") + 1), lambda i: F.substr("lt", i, F.col("size"))))))
        named = parts.select("l", "common", "ln", "ly", "ra").join(surnames, "ra").withColumn("shared", shared).where("shared > 0")
        named = named.withColumn("score", _score(F.col("shared"), F.col("ly") == F.col("ry"), F.lit(True)))
        found = found.unionByName(_best(named, "l"))

    out = _best(found, "l").select(F.col("l").alias(left_id), F.col("r").alias("match_id"), "score", "shared")
    basis = F.when((F.col("score") >= 0.15) & (F.col("shared") >= 2), "overlap").when(F.col("score") >= LEAST, "fallback")
    return out.withColumn("basis", basis).where("basis is not null")
