"""Classification metrics over long predictions: one pass of conditional counts, then arithmetic.

Canonical input columns: ``model, label, pred, gt`` (0/1, ``pred`` may be null).
Any ratio with a zero denominator is 0.0.  Names of F1 variants are never mixed:
``f1_positive, f1_macro, f1_of_macro_pr, f1_micro, f1_weighted, score_b``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_totals


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def f1_from(p: Column, r: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return ratio(2 * p * r, p + r)


def long_labels(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a label from ``{label: (pred column, gt column)}``."""
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(p).cast("int").alias("pred"), F.col(g).cast("int").alias("gt")) for n, (p, g) in pairs.items()])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """``tp, fp, fn, tn, n``; a null prediction is no positive one."""
    pred, gt = F.coalesce(F.col("pred"), F.lit(0)) == 1, F.col("gt") == 1
    return df.groupBy(*by).agg(
        F.count_if(pred & gt).alias("tp"), F.count_if(pred & ~gt).alias("fp"), F.count_if(~pred & gt).alias("fn"), F.count_if(~pred & ~gt).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    )


def per_label(counts: DataFrame) -> DataFrame:
    """Precision, recall, both classes' F1, their mean and support of each row of counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1_positive": f1(tp, fp, fn), "f1_negative": f1(tn, fn, fp),
            "f1_macro": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2, "support": tp + fn,
            "accuracy": ratio(tp + tn, F.col("n")), "fp_rate": ratio(fp, fp + tn), "fn_rate": ratio(fn, fn + tp),
        }
    )


def multilabel_metrics(df: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """Macro, micro and weighted F1, exact match and Score B, aggregated from unrounded per-label values.

    ``macro_*`` average the positive class over labels; ``score_b`` weighs each
    label's two-class macro F1 by its positive support.
    """
    rows = per_label(confusion(df, [*by, "label"]))
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    support = F.sum("support")
    totals = rows.groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1_positive").alias("macro_f1"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
        ratio(F.sum(F.col("support") * F.col("f1_positive")), support).alias("f1_weighted"),
        ratio(F.sum(F.col("support") * F.col("f1_macro")), support).alias("score_b"),
    )
    exact = df.groupBy(*by, id_col).agg(F.min((F.coalesce("pred", F.lit(0)) == F.col("gt")).cast("int")).alias("exact"))
    exact = exact.groupBy(*by).agg(F.avg("exact").alias("exact_match"), F.count(F.lit(1)).alias("n"))
    return totals.join(exact, by) if by else totals.crossJoin(exact)


def score_b(df: DataFrame, by: list[str]) -> DataFrame:
    rows = per_label(confusion(df, [*by, "label"]))
    return rows.groupBy(*by).agg(ratio(F.sum(F.col("support") * F.col("f1_macro")), F.sum("support")).alias("score_b"))


def f1_variants(df: DataFrame, by: list[str]) -> DataFrame:
    """Every F1 of a binary task side by side."""
    r = per_label(confusion(df, by))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    macro_p = (ratio(tp, tp + fp) + ratio(tn, tn + fn)) / 2
    macro_r = (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2
    weighted = ratio((tp + fn) * F.col("f1_positive") + (tn + fp) * F.col("f1_negative"), n)
    return r.select(*by, "f1_positive", "f1_macro", f1_from(macro_p, macro_r).alias("f1_of_macro_pr"), ratio(tp + tn, n).alias("f1_micro"), weighted.alias("f1_weighted"))


def classification_metrics(df: DataFrame, labels: list, by: list[str]) -> DataFrame:
    """Single-label metrics over a given label list: ``pred`` and ``gt`` hold labels.

    Accuracy counts all rows, a null prediction as wrong; macro figures average
    over the list, whether a label occurs or not.
    """
    cells = []
    for x in labels:
        p, g = F.col("pred").eqNullSafe(F.lit(x)), F.col("gt").eqNullSafe(F.lit(x))
        cells.append((F.count_if(p & g), F.count_if(p & ~g), F.count_if(~p & g)))
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / len(labels)
    return df.groupBy(*by).agg(
        F.avg(F.col("pred").eqNullSafe(F.col("gt")).cast("int")).alias("accuracy"),
        mean([ratio(tp, tp + fp) for tp, fp, _ in cells]).alias("macro_precision"),
        mean([ratio(tp, tp + fn) for tp, _, fn in cells]).alias("macro_recall"),
        mean([f1(*c) for c in cells]).alias("f1_macro"),
        F.count(F.lit(1)).alias("n"),
    )


def parsed_only_metrics(df: DataFrame, labels: list, by: list[str]) -> DataFrame:
    """Accuracy over all rows, precision, recall and F1 over parsed rows only; ``status`` tells if none was."""
    every = df.groupBy(*by).agg(F.avg(F.col("pred").eqNullSafe(F.col("gt")).cast("int")).alias("accuracy"), F.count("pred").alias("n_parsed"), F.count(F.lit(1)).alias("n"))
    parsed = classification_metrics(df.where("pred is not null"), labels, by).drop("accuracy", "n")
    zero = {c: 0.0 for c in ("macro_precision", "macro_recall", "f1_macro")}
    out = (every.join(parsed, by, "left") if by else every.crossJoin(parsed)).na.fill(zero)
    return out.withColumn("status", F.when(F.col("n_parsed") == 0, "NONE PARSED").otherwise("OK"))


def rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Three kinds of failure kept apart, from ``pred, refusal, parse_failure, latency_s``."""
    return df.groupBy(*by).agg(
        F.avg(F.col("refusal").cast("int")).alias("refusal_rate"), F.avg(F.col("pred").isNull().cast("int")).alias("no_answer_rate"),
        F.avg(F.col("parse_failure").cast("int")).alias("parse_failure_rate"), F.avg("latency_s").alias("avg_latency_s"),
    )


def roc_auc(df: DataFrame, by: list[str], score: str = "score", gt: str = "gt") -> DataFrame:
    """Mann-Whitney AUC with mid-ranks; null where a group has one class.

    Rows are first counted per distinct score, then running totals over ranges
    of scores tell how many negatives lie below.
    """
    per = df.groupBy(*by, score).agg(F.count_if(F.col(gt) == 1).alias("p"), F.count_if(F.col(gt) == 0).alias("q"))
    per = running_totals(per, by, [score], {"q": "under"}, inclusive=False)
    wins = F.sum(F.col("p") * (F.col("under") + F.col("q") / 2.0))
    return per.groupBy(*by).agg(F.try_divide(wins, (F.sum("p") * F.sum("q")).cast("double")).alias("roc_auc"))


def one_vs_rest_auc(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Mean AUC over labels of long rows ``label, score, gt``, of classes against the rest or of separate labels.

    Null where any label has one class only, as an undefined AUC makes the mean undefined.
    """
    each = roc_auc(df, [*by, label])
    mean = F.when(F.count("roc_auc") == F.count(F.lit(1)), F.avg("roc_auc"))
    return each.groupBy(*by).agg(mean.alias("roc_auc"), F.count(F.lit(1)).alias("n_labels"))


def class_scores_long(df: DataFrame, scores: str, classes: list, gt: str) -> DataFrame:
    """One row an item and class: ``label, score`` of an array of class scores and ``gt`` 1 for the item's own class."""
    place = F.element_at(F.lit(list(classes)), F.col("at") + 1)
    return df.select("*", F.posexplode(scores).alias("at", "score")).select(*[c for c in df.columns if c not in (scores, gt)], place.alias("label"), "score", (F.col(gt) == place).cast("int").alias("gt"))


def sweep_metrics(rows: DataFrame, labels: list, by: list[str]) -> DataFrame:
    """What a sweep prints a model: macro averages for more than two classes, else the positive class with its confusion.

    ``rows`` has ``pred, gt``.  Confusion cells and rates are null for more than two classes.
    """
    if len(labels) > 2:
        out = classification_metrics(rows, labels, by)
        none = {c: F.lit(None).cast("long") for c in ("tp", "fn", "fp", "tn")} | {c: F.lit(None).cast("double") for c in ("fp_rate", "fn_rate")}
        named = {"macro_precision": "precision", "macro_recall": "recall", "f1_macro": "f1"}
        return out.withColumnsRenamed(named).withColumns(none).select(*by, "accuracy", "f1", "precision", "recall", *none)
    each = per_label(confusion(rows, by))
    return each.select(*by, "accuracy", F.col("f1_positive").alias("f1"), "precision", "recall", "tp", "fn", "fp", "tn", "fp_rate", "fn_rate")


def refusal_by_category(df: DataFrame, category: str) -> DataFrame:
    """Refused answers by category as a share of all answers of all categories, and of the category's own."""
    each = df.groupBy(category).agg(F.count_if("refusal").alias("refused"), F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return each.select(category, "refused", "n", (F.col("refused") / whole).alias("share_of_all"), (F.col("refused") / F.col("n")).alias("refusal_rate"))


def mean_latency(df: DataFrame, by: list[str], labels_per_answer: int = 1) -> DataFrame:
    """Mean seconds an answer, and a label where one answer covers several."""
    mean = F.try_divide(F.sum("latency_s"), F.count(F.lit(1)).cast("double"))
    return df.groupBy(*by).agg(mean.alias("avg_latency_s"), (mean / F.lit(float(labels_per_answer))).alias("avg_latency_per_label_s"))


def auc_from_confidence(df: DataFrame, by: list[str]) -> DataFrame:
    """AUC of ``p = confidence`` for prediction 1, else ``1 - confidence``; any null or a single class gives null."""
    scored = df.withColumn("score", F.when(F.col("pred") == 1, F.col("confidence")).otherwise(1 - F.col("confidence")))
    whole = df.groupBy(*by).agg(F.count_if(F.col("gt").isNull() | F.col("pred").isNull() | F.col("confidence").isNull()).alias("nulls"))
    auc = roc_auc(scored, by)
    both = whole.join(auc, by) if by else whole.crossJoin(auc)
    return both.select(*by, F.when(F.col("nulls") == 0, F.col("roc_auc")).alias("roc_auc"))


def thresholds(df: DataFrame) -> DataFrame:
    """The 91 candidate thresholds 0.05 .. 0.95, as a table of numbers."""
    i = df.sparkSession.range(91).select(F.col("id").cast("int").alias("i"))
    return i.withColumn("threshold", F.round(F.lit(0.05) + F.col("i") * F.lit(0.01), 2))


def threshold_scan(df: DataFrame, by: list[str], score: str = "score", gt: str = "gt") -> DataFrame:
    """Macro and positive F1 of ``score >= t`` at every threshold, from one pass over the rows.

    Each row is counted at the highest threshold it reaches; running sums over
    the 91 steps give the counts at all of them.
    """
    step = F.size(F.filter(F.lit([round(0.05 + 0.01 * i, 2) for i in range(91)]), lambda t: t <= F.col(score))) - 1
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, step.alias("i")).agg(F.count_if(F.col(gt) == 1).alias("p"), F.count_if(F.col(gt) == 0).alias("q"))
    groups = counts.select(*by).distinct() if by else counts.limit(1).select()
    grid = groups.crossJoin(F.broadcast(thresholds(df))) if by else thresholds(df)
    under = counts.where("i < 0").groupBy(*by).agg(F.sum("p").alias("p0"), F.sum("q").alias("q0"))
    keys = [*by, "i"]
    full = grid.join(counts.where("i >= 0"), keys, "left").na.fill(0, ["p", "q"])
    full = full.join(under, by, "left") if by else full.crossJoin(under)
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("i")
    upto = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    full = full.select(
        *keys, "threshold", F.sum("p").over(upto).alias("tp"), F.sum("q").over(upto).alias("fp"),
        (F.coalesce(F.sum("p").over(below), F.lit(0)) + F.coalesce("p0", F.lit(0))).alias("fn"),
        (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.coalesce("q0", F.lit(0))).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return full.withColumns({"f1_positive": f1(tp, fp, fn), "f1_macro": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2})


def best_threshold(scan: DataFrame, by: list[str], metric: str = "f1_macro") -> DataFrame:
    """The lowest threshold with the best metric, to nine places."""
    key = F.struct(F.round(metric, 9), -F.col("i"))
    return scan.groupBy(*by).agg(F.max_by("threshold", key).alias("threshold"), F.max(metric).alias(metric))


def apply_threshold(df: DataFrame, best: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """``pred`` from calibrated thresholds; a group without one uses 0.5."""
    joined = df.join(F.broadcast(best.select(*by, "threshold")), by, "left") if by else df.crossJoin(F.broadcast(best.select("threshold")))
    return joined.withColumn("pred", (F.col(score) >= F.coalesce("threshold", F.lit(0.5))).cast("int"))


def label_prevalence(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.agg(*[F.sum(x).alias(x) for x in labels])


def cross_validation_summary(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return scores.groupBy(*by).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))
