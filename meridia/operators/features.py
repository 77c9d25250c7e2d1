"""Feature preparation, always fitted on the training rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .neighbours import nearest
from .selection import exact_quantiles

#: Words whose rows one task of a term count holds on average.
WORDS_PER_TASK = 250_000


def hash_order(id_col: str, seed: int) -> Column:
    """A random-looking order that any engine can reproduce and no partitioning changes."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, id_col: str, label: str, test_share: float = 0.2, seed: int = 4711) -> DataFrame:
    """Column ``split``: per class the first ``ceil(n * share)`` ids in hash order are the test rows.

    A class may hold most rows, so it isn't ranked in one task: rows are counted
    per prefix of the hash, and only the prefix that holds the cut is ranked.
    """
    d = df.withColumn("__h", hash_order(id_col, seed)).withColumn("__p", F.substring("__h", 1, 3))
    counts = d.groupBy(label, "__p").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label)
    counts = counts.select(
        label, "__p", F.ceil(F.sum("__n").over(w) * F.lit(test_share)).alias("__most"),
        F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    k = F.row_number().over(Window.partitionBy(label, "__p").orderBy("__h", id_col))
    placed = d.alias("d").join(counts.alias("c"), F.col(f"d.{label}").eqNullSafe(F.col(f"c.{label}")) & (F.col("d.__p") == F.col("c.__p")))
    placed = placed.select("d.*", "c.__most", "c.__before").withColumn("__k", F.col("__before") + k)
    return placed.withColumn("split", F.when(F.col("__k") <= F.col("__most"), "test").otherwise("train")).select(*df.columns, "split")


def predefined_split(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a split column; null counts as train."""
    is_test = F.col(column).eqNullSafe("test")
    return df.where(~is_test), df.where(is_test)


def impute_numeric(df: DataFrame, train: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``mean`` fills the training *median* (so named by its users), ``zero`` 0.0, ``ignore`` nothing."""
    if how == "ignore":
        return df
    if how == "zero":
        return df.na.fill(0.0, columns)
    if how != "mean":
        raise ValueError(f"unknown imputation {how!r}")
    fill = exact_quantiles(train, {c: [0.5] for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c][0]).cast("double")) for c in columns})


def impute_categorical(df: DataFrame, train: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``mean`` fills the training mode (smallest value on ties), ``zero`` 'missing', ``ignore`` nothing."""
    if how == "ignore":
        return df
    if how == "zero":
        return df.na.fill("missing", columns)
    if how != "mean":
        raise ValueError(f"unknown imputation {how!r}")
    out = df
    for c in columns:
        counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        mode = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(f"__{c}"))
        out = out.crossJoin(F.broadcast(mode)).withColumn(c, F.coalesce(c, f"__{c}")).drop(f"__{c}")
    return out


def scale(df: DataFrame, train: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``standard`` (population deviation), ``minmax``, ``robust`` (median, quartile range) or ``none``; a constant column scales by 1.

    Medians and quartiles are exact, found by counting passes that hold no
    column's values.
    """
    if how == "none":
        return df
    if how not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown scaling {how!r}")
    if how == "robust":
        found = exact_quantiles(train, {c: [0.25, 0.5, 0.75] for c in columns})
        fit = {c: (q[1], None if q[0] is None else q[2] - q[0]) for c, q in found.items()}
    else:
        center = {"standard": F.avg, "minmax": F.min}[how]
        spread = {"standard": F.stddev_pop, "minmax": lambda c: F.max(c) - F.min(c)}[how]
        row = train.agg(*[center(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], *[spread(c).cast("double").alias(f"s{i}") for i, c in enumerate(columns)]).first()
        fit = {c: (row[f"c{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    number = lambda v: F.lit(v).cast("double")
    return df.withColumns({c: (F.col(c) - number(fit[c][0])) / number(1.0 if fit[c][1] == 0 else fit[c][1]) for c in columns})


def category_levels(train: DataFrame, column: str) -> DataFrame:
    """``value, level``: sorted distinct training values numbered from 0."""
    values = train.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.withColumn("level", F.row_number().over(Window.orderBy("value")) - 1)


def ordinal_encode(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """``<column>_level``; an unknown or null value is -1."""
    levels = category_levels(train, column).select(F.col("value").alias("__v"), F.col("level").alias(f"{column}_level"))
    return df.join(levels, F.col(column) == F.col("__v"), "left").drop("__v").na.fill(-1, [f"{column}_level"])


def one_hot(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """``<column>_hot array<double>``; an unknown or null value is all zeros."""
    levels = category_levels(train, column)
    all_ = F.broadcast(levels.agg(F.array_sort(F.collect_list("value")).alias("__levels")))
    hot = F.transform("__levels", lambda v: F.coalesce((v == F.col(column)).cast("double"), F.lit(0.0)))
    return df.crossJoin(all_).withColumn(f"{column}_hot", hot).drop("__levels")


def tfidf(df: DataFrame, is_train: Column, id_col: str, words: str, max_features: int = 1000) -> DataFrame:
    """``id, word, weight`` in long form: term count times ``ln((1 + n) / (1 + df)) + 1``, L2-normalised per row.

    The vocabulary is the ``max_features`` most frequent words of the training
    rows, ties by word.  Words are written once.  Rows are dealt by id into as
    many tasks as their words call for, and only there exploded and counted, so
    a task's memory doesn't grow with the table.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "words")
    rows = df.select(id_col, is_train.alias("__train"), words)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    size = rows.agg(F.count_if("__train").alias("docs"), F.sum(F.greatest(F.size(words), F.lit(0)).cast("long")).alias("words")).first()
    counts = rows.where("__train").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = F.broadcast(counts.orderBy(F.desc("n"), "word").limit(max_features).select("word"))
    dealt = rows.repartition(max(1, -(-(size["words"] or 0) // WORDS_PER_TASK)), id_col)
    found = dealt.select(id_col, "__train", F.explode(words).alias("word")).join(vocabulary, "word")
    terms = found.groupBy(id_col, "__train", "word").agg(F.count(F.lit(1)).alias("tf"))
    df_ = terms.where("__train").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = df_.select("word", (F.log(F.lit(1 + size["docs"]) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = terms.join(F.broadcast(idf), "word").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "word", (F.col("w") / length).alias("weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (k * n_c)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(0))
    return counts.select(label, (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def positive_weights(df: DataFrame, labels: list[str]) -> DataFrame:
    """Negatives by positives per label; 1.0 without a positive."""
    aggs = [F.struct(F.lit(c).alias("label"), F.coalesce(F.try_divide(F.count_if(F.col(c) == 0).cast("double"), F.count_if(F.col(c) == 1).cast("double")), F.lit(1.0)).alias("pos_weight")) for c in labels]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def sample_weight(rare: list[str], common: list[str]) -> Column:
    """1, plus 3 for each rare label and 1 for each common one."""
    out = F.lit(1)
    for c in rare:
        out = out + 3 * F.coalesce(F.col(c), F.lit(0))
    for c in common:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: a linear rise over ``warmup`` steps, then half a cosine down to 0 at ``total``."""
    rise = step / F.lit(max(1, warmup))
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(max(1, total - warmup)))
    return F.when(step < warmup, rise).otherwise(0.5 * (1 + F.cos(F.pi() * done)))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """``<label>_index``: place among the sorted distinct labels."""
    return ordinal_encode(df, df, label).withColumnRenamed(f"{label}_level", f"{label}_index")


def smote(train: DataFrame, id_col: str, vector: str, label: str, minority, per_row: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows between a row and one of its ``k`` nearest minority neighbours.

    ``k`` falls to one less than the class has rows; a class of one row gives
    none.  Neighbours are searched among the minority class only, block against
    block; a task sends on ``k`` of them a row.
    """
    own = train.where(F.col(label) == minority).select(id_col, vector)
    near = nearest(own, own, id_col, vector, k).select(F.col("q").alias("a"), F.col("id").alias("b"))
    near = near.join(own.select(F.col(id_col).alias("a"), F.col(vector).alias("u")), "a").join(own.select(F.col(id_col).alias("b"), F.col(vector).alias("v")), "b")
    pick = near.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    pick = pick.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "a", "i", "b")))
    one = pick.groupBy("a", "i").agg(F.min_by(F.struct("u", "v", "h"), "h").alias("p"))
    t = F.conv(F.substring(F.col("p.h"), 1, 8), 16, 10).cast("double") / float(2**32)
    mixed = F.zip_with("p.u", "p.v", lambda x, y: (x + (y - x) * t).cast("float"))
    return one.select(F.concat_ws("-", F.lit("synthetic"), "a", "i").alias(id_col), mixed.alias(vector), F.lit(minority).alias(label))
