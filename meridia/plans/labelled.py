"""Metrics, calibration, ranking and profiles over ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, profiling, ranking
from ..operators.inference import rule_scores
from ..streaming.confusion import windowed_confusion
from .registry import query, rounded, table

LABELS = ["quality", "toxic"]

SCORED = """scored AS (
  SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars,
         (d.n_chars >= 200)::INT AS pq, contains(lower(coalesce(d.text, '')), 'a')::INT AS pt
  FROM labels l JOIN documents d USING (doc_id)
), long AS (
  SELECT doc_id, lang, 'quality' AS label, pq AS pred, quality AS gt FROM scored
  UNION ALL SELECT doc_id, lang, 'toxic', pt, toxic FROM scored
)"""


def counts_sql(source: str, keys: str, name: str = "c") -> str:
    return f"""{name} AS (
  SELECT {keys}, count(*) FILTER (WHERE pred = 1 AND gt = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND gt = 0) AS fp,
         count(*) FILTER (WHERE pred = 0 AND gt = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND gt = 0) AS tn, count(*) AS n
  FROM {source} GROUP BY {keys}
)"""


def r(a: str, b: str) -> str:
    """A ratio that is 0 for a zero denominator."""
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


FP = r("2*tp", "2*tp+fp+fn")
FN = r("2*tn", "2*tn+fp+fn")


def scored(spark, sf_dir):
    """Labels joined with documents and the built-in rules' predictions ``pq, pt``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    quality, toxic = rule_scores(F.col("text"), F.col("n_chars"))
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return joined.withColumns({"pq": quality, "pt": toxic}).drop("text")


def long(spark, sf_dir):
    return metrics.long_labels(scored(spark, sf_dir), ["doc_id", "lang"], {"quality": ("pq", "quality"), "toxic": ("pt", "toxic")})


@query(f"""WITH {SCORED}, {counts_sql('long', 'label')}
SELECT round({r(f'sum((tp+fn) * ({FP} + {FN}) / 2)', 'sum(tp+fn)')}, 6) AS score_b FROM c""")
def score_b(spark, sf_dir):
    return rounded(metrics.score_b(long(spark, sf_dir), []))


@query(f"""WITH {SCORED}, {counts_sql('long', 'label')}, e AS (
  SELECT doc_id, min((pred = gt)::INT) AS exact FROM long GROUP BY doc_id
)
SELECT round(avg({r('tp', 'tp+fp')}), 6) AS macro_precision, round(avg({r('tp', 'tp+fn')}), 6) AS macro_recall,
       round(avg({FP}), 6) AS macro_f1, round({r('2*sum(tp)', '2*sum(tp)+sum(fp)+sum(fn)')}, 6) AS f1_micro,
       round({r(f'sum((tp+fn)*{FP})', 'sum(tp+fn)')}, 6) AS f1_weighted,
       round({r(f'sum((tp+fn) * ({FP} + {FN}) / 2)', 'sum(tp+fn)')}, 6) AS score_b,
       (SELECT round(avg(exact), 6) FROM e) AS exact_match, (SELECT count(*) FROM e) AS n
FROM c""")
def multilabel_metrics(spark, sf_dir):
    return rounded(metrics.multilabel_metrics(long(spark, sf_dir), "doc_id", []))


@query(f"""WITH {SCORED}, {counts_sql('long', 'label')}
SELECT label, tp, fp, fn, tn, n, round({r('tp', 'tp+fp')}, 6) AS precision, round({r('tp', 'tp+fn')}, 6) AS recall,
       round({FP}, 6) AS f1_positive, round({FN}, 6) AS f1_negative, round(({FP} + {FN}) / 2, 6) AS f1_macro, tp + fn AS support,
       round({r('tp+tn', 'n')}, 6) AS accuracy, round({r('fp', 'fp+tn')}, 6) AS fp_rate, round({r('fn', 'fn+tp')}, 6) AS fn_rate
FROM c""")
def per_label_f1(spark, sf_dir):
    return rounded(metrics.per_label(metrics.confusion(long(spark, sf_dir), ["label"])))


@query(f"WITH {SCORED}, {counts_sql('long', 'lang, label')} SELECT * FROM c")
def confusion_by_lang(spark, sf_dir):
    return metrics.confusion(long(spark, sf_dir), ["lang", "label"])


@query(f"""WITH {SCORED}, {counts_sql('long', 'label')}, m AS (
  SELECT *, ({r('tp', 'tp+fp')} + {r('tn', 'tn+fn')}) / 2 AS p, ({r('tp', 'tp+fn')} + {r('tn', 'tn+fp')}) / 2 AS q FROM c
)
SELECT label, round({FP}, 6) AS f1_positive, round(({FP} + {FN}) / 2, 6) AS f1_macro, round({r('2*p*q', 'p+q')}, 6) AS f1_of_macro_pr,
       round({r('tp+tn', 'n')}, 6) AS f1_micro, round({r(f'(tp+fn)*{FP} + (tn+fp)*{FN}', 'n')}, 6) AS f1_weighted
FROM m""")
def f1_variants(spark, sf_dir):
    return rounded(metrics.f1_variants(long(spark, sf_dir), ["label"]))


@query(f"""WITH {SCORED}, x AS (
  SELECT lang AS pred, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN lang ELSE 'en' END AS p, source FROM scored
), l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS k), c AS (
  SELECT k, count(*) FILTER (WHERE p = k AND pred = k) AS tp, count(*) FILTER (WHERE p = k AND pred <> k) AS fp,
         count(*) FILTER (WHERE pred = k AND p IS DISTINCT FROM k) AS fn FROM l, x GROUP BY k
)
SELECT round((SELECT avg((p IS NOT DISTINCT FROM pred)::INT) FROM x), 6) AS accuracy, round(avg({r('tp', 'tp+fp')}), 6) AS macro_precision,
       round(avg({r('tp', 'tp+fn')}), 6) AS macro_recall, round(avg({FP}), 6) AS f1_macro, (SELECT count(*) FROM x) AS n
FROM c""")
def classification_metrics(spark, sf_dir):
    """A guesser that answers nothing, the truth or ``en`` in turn; ``it`` never occurs and still counts."""
    return rounded(metrics.classification_metrics(_guesses(spark, sf_dir), ["en", "fr", "de", "es", "it"], []))


def _guesses(spark, sf_dir):
    rest = F.col("n_chars") % 3
    guess = F.when(rest == 0, F.lit(None)).when(rest == 1, F.col("lang")).otherwise("en")
    return scored(spark, sf_dir).select(guess.alias("pred"), F.col("lang").alias("gt"))


@query(f"""WITH {SCORED}, x AS (
  SELECT lang AS g, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN lang ELSE 'en' END AS p FROM scored
), l AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS k), c AS (
  SELECT k, count(*) FILTER (WHERE p = k AND g = k) AS tp, count(*) FILTER (WHERE p = k AND g <> k) AS fp,
         count(*) FILTER (WHERE g = k AND p <> k) AS fn FROM l, x WHERE p IS NOT NULL GROUP BY k
)
SELECT round((SELECT avg((p IS NOT DISTINCT FROM g)::INT) FROM x), 6) AS accuracy, (SELECT count(p) FROM x) AS n_parsed, (SELECT count(*) FROM x) AS n,
       round(avg({r('tp', 'tp+fp')}), 6) AS macro_precision, round(avg({r('tp', 'tp+fn')}), 6) AS macro_recall, round(avg({FP}), 6) AS f1_macro, 'OK' AS status
FROM c""")
def parsed_only_metrics(spark, sf_dir):
    return rounded(metrics.parsed_only_metrics(_guesses(spark, sf_dir), ["en", "fr", "de", "es"], []))


@query(f"""WITH {SCORED}, k AS (
  SELECT n_chars AS s, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q FROM scored GROUP BY 1
), w AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM k)
SELECT round(sum(p * (under + q / 2.0)) / (sum(p) * sum(q)), 6) AS roc_auc FROM w""")
def roc_auc(spark, sf_dir):
    d = scored(spark, sf_dir).select(F.col("n_chars").alias("score"), F.col("quality").alias("gt"))
    return rounded(metrics.roc_auc(d, []))


@query(f"""WITH {SCORED}, a AS (
  SELECT toxic AS gt, CASE WHEN pt = 1 THEN 0.5 + (n_chars % 50) / 100.0 ELSE 1 - (0.5 + (n_chars % 50) / 100.0) END::DOUBLE AS s FROM scored
), k AS (SELECT round(s, 9) AS s, count(*) FILTER (WHERE gt = 1) AS p, count(*) FILTER (WHERE gt = 0) AS q FROM a GROUP BY 1
), w AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM k)
SELECT round(sum(p * (under + q / 2.0)) / (sum(p) * sum(q)), 6) AS roc_auc FROM w""")
def auc_from_confidence(spark, sf_dir):
    d = scored(spark, sf_dir).select(F.col("toxic").alias("gt"), F.col("pt").alias("pred"), F.round(0.5 + (F.col("n_chars") % 50) / 100.0, 9).alias("confidence"))
    return rounded(metrics.auc_from_confidence(d, []))


SCAN = f"""{SCORED}, s AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality AS gt FROM scored),
g AS (SELECT i::INT AS i, round(0.05 + i * 0.01, 2)::DOUBLE AS threshold FROM range(91) t(i))"""


def _scores(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("score"), F.col("quality").alias("gt"))


def scan_counts(where: str = "TRUE") -> str:
    return f"""c AS (
  SELECT i, threshold, count(*) FILTER (WHERE score >= threshold AND gt = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND gt = 0) AS fp,
         count(*) FILTER (WHERE score < threshold AND gt = 1) AS fn, count(*) FILTER (WHERE score < threshold AND gt = 0) AS tn
  FROM g, s WHERE {where} GROUP BY i, threshold
)"""


@query(f"WITH {SCAN}, {scan_counts()} SELECT *, round({FP}, 6) AS f1_positive, round(({FP} + {FN}) / 2, 6) AS f1_macro FROM c")
def threshold_scan(spark, sf_dir):
    return rounded(metrics.threshold_scan(_scores(spark, sf_dir), []))


@query(f"""WITH {SCAN}, {scan_counts()}
SELECT threshold, round(({FP} + {FN}) / 2, 6) AS f1_macro FROM c ORDER BY round(({FP} + {FN}) / 2, 9) DESC, i LIMIT 1""")
def best_threshold(spark, sf_dir):
    return rounded(metrics.best_threshold(metrics.threshold_scan(_scores(spark, sf_dir), []), []))


@query(f"""WITH {SCAN}, {scan_counts('doc_id % 2 = 0')}, b AS (
  SELECT threshold FROM c ORDER BY round(({FP} + {FN}) / 2, 9) DESC, i LIMIT 1
), t AS (SELECT (score >= (SELECT threshold FROM b))::INT AS pred, gt FROM s WHERE doc_id % 2 = 1), {counts_sql('t', "'test'", 'k')}
SELECT round({FP}, 6) AS f1_positive, round(({FP} + {FN}) / 2, 6) AS f1_macro, round({r('tp+tn', 'n')}, 6) AS accuracy, (SELECT threshold FROM b) AS threshold FROM k""")
def calibrated_test_metrics(spark, sf_dir):
    """A threshold fitted on even ids, applied to odd ones."""
    s = _scores(spark, sf_dir)
    best = metrics.best_threshold(metrics.threshold_scan(s.where("doc_id % 2 = 0"), []), [])
    test = metrics.apply_threshold(s.where("doc_id % 2 = 1"), best, [])
    out = metrics.per_label(metrics.confusion(test, ["threshold"]))
    return rounded(out.select("f1_positive", "f1_macro", "accuracy", "threshold"))


@query(f"""WITH {SCORED}, g AS (SELECT *, pq = 0 AS gated FROM scored), long2 AS (
  SELECT doc_id, 'quality' AS label, CASE WHEN gated THEN 0 ELSE pt END AS pred, quality AS gt FROM g
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN gated THEN 0 ELSE pq END, toxic FROM g
), {counts_sql('long2', 'label')}
SELECT (SELECT count(*) FROM g) AS n_images, (SELECT count(*) FILTER (WHERE gated) FROM g) AS n_gated,
       round({r(f'sum((tp+fn) * ({FP} + {FN}) / 2)', 'sum(tp+fn)')}, 6) AS score_b FROM c""")
def two_stage_gate(spark, sf_dir):
    s = scored(spark, sf_dir)
    first = s.select(F.col("doc_id").alias("image_id"), F.col("pq").alias("pred"))
    second = s.select(F.col("doc_id").alias("image_id"), F.array("pt", "pq").alias("pred"), "quality", "toxic")
    gated = ranking.gate(first, second).withColumns({"p0": F.col("pred")[0], "p1": F.col("pred")[1]})
    rows = metrics.long_labels(gated, ["image_id"], {"quality": ("p0", "quality"), "toxic": ("p1", "toxic")})
    n = gated.agg(F.count(F.lit(1)).alias("n_images"), F.count_if("gated").alias("n_gated"))
    return rounded(n.crossJoin(metrics.score_b(rows, [])))


MODELS = f"""{SCORED}, m AS (
  SELECT 'always' AS model, 1 AS ordinal, 1 AS pred, quality AS gt, doc_id FROM scored
  UNION ALL SELECT 'length', 2, pq, quality, doc_id FROM scored UNION ALL SELECT 'letter', 3, pt, quality, doc_id FROM scored
  UNION ALL SELECT 'never', 4, 0, quality, doc_id FROM scored
), {counts_sql('m', 'model, ordinal')}"""


def _models(spark, sf_dir):
    rules = [("always", F.lit(1)), ("length", F.col("pq")), ("letter", F.col("pt")), ("never", F.lit(0))]
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ordinal"), p.cast("int").alias("pred")) for i, (n, p) in enumerate(rules, 1)])
    return scored(spark, sf_dir).select("doc_id", F.col("quality").alias("gt"), F.explode(rows).alias("m")).select("doc_id", "gt", "m.*")


def _board(spark, sf_dir):
    return metrics.per_label(metrics.confusion(_models(spark, sf_dir), ["model", "ordinal"])).select("model", "ordinal", "accuracy", "f1_macro", "f1_positive")


BOARD = f"SELECT model, ordinal, round({r('tp+tn', 'n')}, 6) AS accuracy, round(({FP}+{FN})/2, 6) AS f1_macro, round({FP}, 6) AS f1_positive FROM c"


@query(f"WITH {MODELS}, b AS ({BOARD}) SELECT *, row_number() OVER (ORDER BY f1_macro DESC NULLS LAST, ordinal)::INT AS rank FROM b")
def leaderboard(spark, sf_dir):
    return ranking.leaderboard(rounded(_board(spark, sf_dir)), "f1_macro", "ordinal")


@query(f"WITH {MODELS}, b AS ({BOARD}) SELECT * FROM b ORDER BY f1_macro DESC NULLS LAST, ordinal LIMIT 1")
def best_model(spark, sf_dir):
    return ranking.best_row(rounded(_board(spark, sf_dir)), "f1_macro", "ordinal")


@query(f"""WITH {MODELS}, v AS (SELECT * FROM m WHERE doc_id % 2 = 0 AND model <> 'never'), t AS (SELECT * FROM m WHERE doc_id % 2 = 1 AND model <> 'always'),
{counts_sql('v', 'model', 'cv')}, {counts_sql('t', 'model', 'ct')}, n AS (SELECT DISTINCT model FROM m),
a AS (SELECT model, ({FP}+{FN})/2 AS f FROM cv), b AS (SELECT model, ({FP}+{FN})/2 AS f FROM ct)
SELECT n.model, round(a.f, 6) AS validation, round(b.f, 6) AS test, round(a.f - b.f, 6) AS gap FROM n LEFT JOIN a USING (model) LEFT JOIN b USING (model)""")
def val_test_gap(spark, sf_dir):
    m = _models(spark, sf_dir)
    board = lambda d: metrics.per_label(metrics.confusion(d, ["model"]))
    validation = board(m.where("doc_id % 2 = 0 and model <> 'never'"))
    test = board(m.where("doc_id % 2 = 1 and model <> 'always'"))
    return rounded(ranking.compare_splits(validation, test, m.select("model").distinct(), "f1_macro"))


@query(f"""WITH {SCORED}, x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'blur' END AS filter, lang AS subset, 'rule' AS model, pq AS pred, quality AS gt FROM scored),
{counts_sql('x', 'model, subset, filter')}, a AS (SELECT *, ({FP}+{FN})/2 AS f FROM c), g AS (SELECT 'rule' AS model, unnest(['de', 'en', 'es', 'fr', 'it']) AS subset)
SELECT g.model, g.subset, round(n.f, 6) AS base, round(b.f, 6) AS changed, round(b.f - n.f, 6) AS difference
FROM g LEFT JOIN a n ON n.subset = g.subset AND n.filter = 'none' LEFT JOIN a b ON b.subset = g.subset AND b.filter = 'blur'""")
def filter_ablation(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, "none").otherwise("blur").alias("filter"), F.col("lang").alias("subset"), F.lit("rule").alias("model"), F.col("pq").alias("pred"), F.col("quality").alias("gt"))
    results = metrics.per_label(metrics.confusion(rows, ["model", "subset", "filter"]))
    models = spark.createDataFrame([("rule",)], "model string")
    subsets = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "subset string")
    return rounded(ranking.ablation(results, models, subsets, "none", "blur", "f1_macro"))


@query("SELECT sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic FROM labels")
def label_prevalence(spark, sf_dir):
    return metrics.label_prevalence(table(spark, sf_dir, "labels"), LABELS)


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS positive, count(*) FILTER (WHERE toxic = 0) AS negative, sum(quality)::BIGINT AS quality FROM labels""")
def dataset_stats(spark, sf_dir):
    return profiling.dataset_stats(table(spark, sf_dir, "labels"), "toxic", ["quality"])


@query("""WITH k AS (SELECT unnest(['quality', 'toxic']) AS a), p AS (SELECT x.a, y.a AS b FROM k x, k y), v AS (
  SELECT p.a, p.b, sum((CASE p.a WHEN 'quality' THEN quality ELSE toxic END) * (CASE p.b WHEN 'quality' THEN quality ELSE toxic END))::BIGINT AS both FROM p, labels GROUP BY 1, 2
)
SELECT v.a, v.b, v.both, round(v.both / o.both, 6)::DOUBLE AS given_a FROM v JOIN v o ON o.a = v.a AND o.b = v.a""")
def cooccurrence(spark, sf_dir):
    return rounded(profiling.cooccurrence(table(spark, sf_dir, "labels"), LABELS))


@query("SELECT b.i::INT AS active, count(l.doc_id) AS n FROM range(3) b(i) LEFT JOIN labels l ON l.quality + l.toxic = b.i GROUP BY 1")
def active_count_hist(spark, sf_dir):
    return profiling.active_count_histogram(table(spark, sf_dir, "labels"), LABELS)


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS positive_without, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS negative_with FROM labels")
def inconsistencies(spark, sf_dir):
    return profiling.inconsistencies(table(spark, sf_dir, "labels"), "quality", ["toxic"])


@query("SELECT lang AS value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percentage FROM documents GROUP BY lang")
def target_distribution(spark, sf_dir):
    return rounded(profiling.target_distribution(table(spark, sf_dir, "documents"), "lang"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'round(corr({min(a, b)}, {max(a, b)}), 6)'}::DOUBLE AS r FROM {'(SELECT 1)' if a == b else 'lineitem'}" for a in _NUMBERS for b in _NUMBERS))
def correlation_matrix(spark, sf_dir):
    return rounded(profiling.correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL OR trim(text) = '' OR lang IS NULL) AS n_missing, count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de')) AS n_outside, min(CASE WHEN text IS NULL OR trim(text) = '' OR lang IS NULL OR lang NOT IN ('en', 'fr', 'de') THEN doc_id::VARCHAR END) AS first_bad_id, (SELECT list(i ORDER BY i) FROM (SELECT doc_id::VARCHAR AS i FROM documents WHERE text IS NULL OR trim(text) = '' OR lang IS NULL OR lang NOT IN ('en', 'fr', 'de') ORDER BY i LIMIT 5)) AS bad_ids, '' AS missing_columns, FALSE AS valid FROM documents")
def dataset_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return profiling.verify(docs, ["text", "lang"], {"lang": ["en", "fr", "de"]}, None, "doc_id")


@query("SELECT count(DISTINCT toxic) = 2 AS complete, count(*) >= 5000 AS large_enough FROM labels")
def composition(spark, sf_dir):
    return profiling.composition(table(spark, sf_dir, "labels"), "toxic")


@query("SELECT k AS lang, count(d.doc_id) AS n, count(d.doc_id) > 0 AS present FROM (SELECT unnest(['de', 'en', 'it']) AS k) LEFT JOIN documents d ON d.lang = k GROUP BY k")
def category_counts(spark, sf_dir):
    return profiling.category_counts(table(spark, sf_dir, "documents"), "lang", ["de", "en", "it"])


@query(f"""WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, (value >= 10)::INT AS pred, (event_type = 'purchase')::INT AS gt FROM events), {counts_sql('e', 'day')}
SELECT strftime(day, '%Y-%m-%d') AS day, tp, fp, fn, tn, n, round(({FP}+{FN})/2, 6) AS f1_macro FROM c""")
def windowed_confusion_by_day(spark, sf_dir):
    """Extension: the streaming metric over the event table at rest."""
    e = table(spark, sf_dir, "events").select("ts", (F.col("value") >= 10).cast("int").alias("pred"), (F.col("event_type") == "purchase").cast("int").alias("gt"))
    out = windowed_confusion(e, "ts")
    return rounded(out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tp", "fp", "fn", "tn", "n", "f1_macro"))
