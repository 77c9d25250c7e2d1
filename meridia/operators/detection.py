"""Detection scoring: overlap, one-to-one matching, average precision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_totals

IOU_STEPS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes, columns ``<prefix>x1`` .. ``<prefix>y2``; 0 for an empty union."""
    c = lambda p, n: F.col(f"{p}{n}")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo)))
    area = lambda p: F.greatest(F.lit(0.0), c(p, "x2") - c(p, "x1")) * F.greatest(F.lit(0.0), c(p, "y2") - c(p, "y1"))
    both = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def _boxes(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("image_id", *[F.col(n).alias(prefix + n) for n in ("x1", "y1", "x2", "y2")], *more)


def match_single(detections: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, image_id, ordinal, confidence, tp`` where an image has at most one true box.

    By falling confidence the first detection that reaches the overlap takes
    the box; ``ordinal`` breaks ties and must be unique within an image.
    """
    pairs = _boxes(detections, "p_", "confidence", "ordinal").join(_boxes(truth, "g_"), "image_id", "left")
    pairs = pairs.withColumn("iou", F.when(F.col("g_x1").isNotNull(), iou("p_", "g_")).otherwise(0.0))
    image, rank = Window.partitionBy("image_id"), F.struct("confidence", F.col("ordinal").isNull(), -F.col("ordinal"))
    taken = []
    for t in thresholds:
        # One window by image serves all thresholds: the join has dealt the rows by image already.
        reaches = F.col("g_x1").isNotNull() & (F.col("iou") >= F.lit(t))
        first = reaches & rank.eqNullSafe(F.max(F.when(reaches, rank)).over(image))
        taken.append(F.struct(F.lit(t).alias("threshold"), F.coalesce(first, F.lit(False)).cast("int").alias("tp")))
    each = pairs.select("image_id", "ordinal", "confidence", F.array(*taken).alias("steps"))
    return each.select("image_id", "ordinal", "confidence", F.inline("steps")).select("threshold", "image_id", "ordinal", "confidence", "tp")


def match_greedy(detections: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """As ``match_single`` for any number of true boxes: each detection takes the first unmatched one it reaches.

    Images are independent, so each is one small group.
    """
    p = detections.select("image_id", F.struct("confidence", "ordinal", "x1", "y1", "x2", "y2").alias("b")).groupBy("image_id").agg(F.collect_list("b").alias("p"))
    g = truth.select("image_id", F.struct("ordinal", "x1", "y1", "x2", "y2").alias("b")).groupBy("image_id").agg(F.sort_array(F.collect_list("b")).alias("g"))

    def overlap(a, b) -> float:
        w = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]))
        h = max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
        area = sum(max(0.0, r["x2"] - r["x1"]) * max(0.0, r["y2"] - r["y1"]) for r in (a, b)) - w * h
        return w * h / area if area > 0 else 0.0

    def work(batches):
        for batch in batches:
            rows = []
            for image, found, boxes in zip(batch["image_id"], batch["p"], batch["g"]):
                boxes = [] if boxes is None else list(boxes)
                ranked = sorted(found, key=lambda d: (-d["confidence"], d["ordinal"]))
                for t in thresholds:
                    free = list(range(len(boxes)))
                    for d in ranked:
                        hit = next((i for i in free if overlap(d, boxes[i]) >= t), None)
                        if hit is not None:
                            free.remove(hit)
                        rows.append((t, image, d["ordinal"], d["confidence"], int(hit is not None)))
            yield pd.DataFrame(rows, columns=["threshold", "image_id", "ordinal", "confidence", "tp"])

    kind = dict(detections.dtypes)
    schema = f"threshold double, image_id {kind['image_id']}, ordinal {kind['ordinal']}, confidence double, tp int"
    return p.join(g, "image_id", "left").mapInPandas(work, schema)


def metrics_by_group(matches: DataFrame, truth: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Counts and average precision of every group of images, for instance of one visibility; ``groups`` has ``image_id`` and the group."""
    of = groups.select("image_id", group)
    found = truth.join(of, "image_id").groupBy(group).agg(F.count(F.lit(1)).alias("n_truth"))
    ap = _curves(matches.join(of, "image_id"), truth.join(of, "image_id"), [group]).where(F.col(group).isNotNull())
    out = ap.withColumn("fp", F.col("n") - F.col("tp")).join(found, group, "left").na.fill(0, ["n_truth"])
    fn = F.greatest(F.lit(0), F.col("n_truth") - F.col("tp"))
    r = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.select(group, "threshold", "tp", "fp", fn.alias("fn"), r(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), r(F.col("tp"), F.col("tp") + fn).alias("recall"), "ap")


def detection_counts(matches: DataFrame, truth: DataFrame) -> DataFrame:
    n = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    sums = matches.groupBy("threshold").agg(F.sum("tp").cast("long").alias("tp"), F.sum(1 - F.col("tp")).cast("long").alias("fp"))
    out = sums.crossJoin(F.broadcast(n)).withColumn("fn", F.greatest(F.lit(0), F.col("n_truth") - F.col("tp")))
    r = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn)})


def average_precision(matches: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """101-point average precision per threshold (and group, if columns of both tables name one); 0 without a true box.

    Running counts are taken over ranges of the confidence order, so no task
    holds a whole threshold.  A detection reaches the recall levels up to
    ``floor(100 * true positives / true boxes)``; the best precision at each
    highest level, then the best from each level up, is all the curve needs.
    """
    return _curves(matches, truth, by or []).select(*(by or []), "threshold", "ap")


def _curves(matches: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """``average_precision`` with ``tp`` and ``n``, the true positives and all detections of each curve."""
    keys = [*by, "threshold"]
    n = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("n_truth"))
    found = matches.select(*keys, (-F.col("confidence")).alias("fall"), "image_id", "ordinal", F.col("tp").cast("long").alias("tp"), F.lit(1).cast("long").alias("one"))
    curve = running_totals(found, keys, ["fall", "image_id", "ordinal"], {"tp": "ctp", "one": "k"})
    curve = curve.join(n, by, "left").na.fill(0, ["n_truth"]) if by else curve.crossJoin(F.broadcast(n))
    level = F.when(F.col("n_truth") > 0, F.least(F.lit(100), F.expr("100 * ctp div nullif(n_truth, 0)")))
    best = curve.groupBy(*keys, level.cast("int").alias("level")).agg(F.max(F.col("ctp") / F.col("k")).alias("precision"), F.max("ctp").alias("tp"), F.max("k").alias("n"))
    upto = best.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("level", F.lit(0)))))
    upto = upto.groupBy(*keys, "i").agg(F.max(F.when(F.col("level").isNotNull(), F.col("precision"))).alias("p"), F.max("tp").alias("tp"), F.max("n").alias("n"))
    return upto.groupBy(*keys).agg((F.sum(F.coalesce("p", F.lit(0.0))) / 101.0).alias("ap"), F.max("tp").alias("tp"), F.max("n").alias("n"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
