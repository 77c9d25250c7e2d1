"""Detection queries over boxes made from order lines: an order's first line is the true box, the others are detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detection
from .registry import query, rounded, table

BOXES = """k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)::INT AS ordinal FROM lineitem),
g AS (SELECT l_orderkey AS image_id, l_quantity AS w FROM k WHERE ordinal = 1),
d AS (SELECT l_orderkey AS image_id, ordinal, l_quantity AS w, round(l_discount * 10, 2) AS confidence FROM k WHERE ordinal > 1),
b AS (SELECT d.*, CASE WHEN g.w IS NULL THEN 0 ELSE least(d.w, g.w) / greatest(d.w, g.w) END AS iou, g.w IS NOT NULL AS has FROM d LEFT JOIN g USING (image_id)),
t AS (SELECT unnest([0.5, 0.75]) AS threshold),
m AS (SELECT t.threshold, b.image_id, ordinal, confidence, (has AND iou >= threshold AND row_number() OVER (PARTITION BY threshold, image_id, has AND iou >= threshold ORDER BY confidence DESC, ordinal) = 1)::INT AS tp FROM b, t)"""


def boxes(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    lines = table(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(order)).select(
        F.col("l_orderkey").alias("image_id"), "ordinal", F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.lit(10.0).alias("y2"),
    )
    return lines.where("ordinal > 1"), lines.where("ordinal = 1").drop("confidence")


def _matches(spark, sf_dir):
    found, truth = boxes(spark, sf_dir)
    return detection.match_single(found, truth, [0.5, 0.75]), truth


@query(f"WITH {BOXES} SELECT image_id, ordinal, round(iou, 6) AS iou FROM b")
def iou_pairs(spark, sf_dir):
    found, truth = boxes(spark, sf_dir)
    p = found.select("image_id", "ordinal", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    g = truth.select("image_id", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = p.join(g, "image_id", "left")
    return rounded(both.select("image_id", "ordinal", F.when(F.col("g_x1").isNull(), 0.0).otherwise(detection.iou("p_", "g_")).alias("iou")))


@query(f"""WITH {BOXES}, c AS (SELECT threshold, sum(tp)::BIGINT AS tp, sum(1 - tp)::BIGINT AS fp FROM m GROUP BY threshold), n AS (SELECT count(*) AS n_truth FROM g)
SELECT threshold::DOUBLE AS threshold, tp, fp, n_truth, greatest(0, n_truth - tp) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + greatest(0, n_truth - tp)), 6) AS recall,
       round(2 * tp / (2 * tp + fp + greatest(0, n_truth - tp)), 6) AS f1 FROM c, n""")
def detection_match(spark, sf_dir):
    matches, truth = _matches(spark, sf_dir)
    return rounded(detection.detection_counts(matches, truth))


@query(f"""WITH {BOXES}, c AS (SELECT threshold, sum(tp)::BIGINT AS tp, sum(1 - tp)::BIGINT AS fp FROM m GROUP BY threshold) SELECT threshold::DOUBLE AS threshold, tp, fp FROM c""")
def detection_match_greedy(spark, sf_dir):
    """The general matcher; with one box an image it equals the single one."""
    found, truth = boxes(spark, sf_dir)
    matches = detection.match_greedy(found, truth, [0.5, 0.75])
    return matches.groupBy("threshold").agg(F.sum("tp").cast("long").alias("tp"), F.sum(1 - F.col("tp")).cast("long").alias("fp"))


AP = f"""WITH {BOXES}, n AS (SELECT count(*) AS n_truth FROM g), q AS (
  SELECT threshold, sum(tp) OVER (PARTITION BY threshold ORDER BY confidence DESC, image_id, ordinal ROWS UNBOUNDED PRECEDING) AS ctp,
         row_number() OVER (PARTITION BY threshold ORDER BY confidence DESC, image_id, ordinal) AS k FROM m
), r AS (SELECT threshold, ctp / n_truth AS recall, max(ctp / k) AS precision FROM q, n GROUP BY 1, 2),
v AS (SELECT threshold, recall, max(precision) OVER (PARTITION BY threshold ORDER BY recall ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision FROM r),
l AS (SELECT i / 100.0::DOUBLE AS level FROM range(101) t(i)), h AS (SELECT threshold, level, max(precision) AS p FROM v JOIN l ON recall >= level GROUP BY 1, 2),
a AS (SELECT threshold, sum(p) / 101 AS ap FROM h GROUP BY threshold)"""


@query(f"{AP} SELECT threshold::DOUBLE AS threshold, round(ap, 6) AS ap FROM a")
def average_precision(spark, sf_dir):
    return rounded(detection.average_precision(*_matches(spark, sf_dir)))


@query(f"{AP} SELECT round(max(CASE WHEN threshold = 0.5 THEN ap END), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM a")
def mean_average_precision(spark, sf_dir):
    return rounded(detection.mean_average_precision(detection.average_precision(*_matches(spark, sf_dir))))


@query(f"""WITH {BOXES}, v AS (SELECT *, image_id % 3 AS visibility FROM m), tr AS (SELECT image_id % 3 AS visibility, count(*) AS n_truth FROM g GROUP BY 1),
c AS (SELECT visibility, threshold, sum(tp)::BIGINT AS tp, sum(1 - tp)::BIGINT AS fp FROM v GROUP BY 1, 2), q AS (
  SELECT visibility, threshold, sum(tp) OVER w AS ctp, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY visibility, threshold ORDER BY confidence DESC, image_id, ordinal ROWS UNBOUNDED PRECEDING)
), l AS (SELECT i / 100.0::DOUBLE AS level FROM range(101) t(i)), h AS (SELECT q.visibility, threshold, level, max(ctp / k) AS p FROM q JOIN tr USING (visibility) JOIN l ON ctp / n_truth >= level GROUP BY 1, 2, 3),
a AS (SELECT visibility, threshold, sum(p) / 101 AS ap FROM h GROUP BY 1, 2)
SELECT c.visibility, c.threshold::DOUBLE AS threshold, tp, fp, n_truth - tp AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / n_truth, 6) AS recall, round(ap, 6) AS ap FROM c JOIN tr USING (visibility) JOIN a USING (visibility, threshold)""")
def detection_by_visibility(spark, sf_dir):
    matches, truth = _matches(spark, sf_dir)
    groups = truth.select("image_id", (F.col("image_id") % 3).alias("visibility"))
    return rounded(detection.metrics_by_group(matches, truth, groups, "visibility"))
