"""Feature preparation, weights and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_words
from ..operators import features, preparation, sampling
from .registry import query, rounded, table
from .texts import CLEAN

GAPS = "e AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 2 THEN NULL ELSE event_type END AS kind, event_id % 5 = 0 AS test FROM events)"


def _gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 2, F.col("event_type")).alias("kind"),
        (F.col("event_id") % 5 == 0).alias("test"),
    )


@query(f"""WITH {GAPS}, m AS (SELECT median(value) AS m FROM e WHERE NOT test), f AS (SELECT event_id, test, coalesce(value, m) AS v FROM e, m), s AS (SELECT avg(v) AS a, stddev_pop(v) AS d FROM f WHERE NOT test)
SELECT event_id, round((v - a) / d, 6) AS value FROM f, s""")
def impute_scale(spark, sf_dir):
    e = _gaps(spark, sf_dir)
    filled = features.impute_numeric(e, e.where("not test"), ["value"], "mean")
    return rounded(features.scale(filled, filled.where("not test"), ["value"], "standard").select("event_id", "value"))


@query(f"""WITH {GAPS}, k AS (SELECT kind FROM e WHERE NOT test AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) SELECT event_id, coalesce(e.kind, k.kind) AS kind FROM e, k""")
def impute_mode(spark, sf_dir):
    e = _gaps(spark, sf_dir)
    return features.impute_categorical(e, e.where("not test"), ["kind"], "mean").select("event_id", "kind")


@query(f"""WITH {GAPS}, l AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS i FROM (SELECT DISTINCT kind FROM e WHERE NOT test AND kind IS NOT NULL AND kind <> 'view')) SELECT event_id, coalesce(l.i, -1)::INT AS kind_level FROM e LEFT JOIN l USING (kind)""")
def ordinal_encode(spark, sf_dir):
    """``view`` is kept out of training, so it is unknown."""
    e = _gaps(spark, sf_dir)
    return features.ordinal_encode(e, e.where("not test and kind <> 'view'"), "kind").select("event_id", "kind_level")


@query(f"""WITH {GAPS} SELECT event_id, coalesce((kind = 'click')::INT, 0)::DOUBLE AS click, coalesce((kind = 'signup')::INT, 0)::DOUBLE AS signup, CASE WHEN kind IS NULL OR kind = 'view' THEN 0.0 ELSE 1.0 END::DOUBLE AS total FROM e""")
def one_hot(spark, sf_dir):
    e = _gaps(spark, sf_dir)
    hot = features.one_hot(e, e.where("not test and kind <> 'view'"), "kind")
    total = F.aggregate("kind_hot", F.lit(0.0), lambda s, x: s + x)
    return hot.select("event_id", F.col("kind_hot")[0].alias("click"), F.col("kind_hot")[3].alias("signup"), total.alias("total"))


@query(f"""WITH d AS (SELECT doc_id, {CLEAN.format(t='text')} AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS word FROM d),
v AS (SELECT word FROM x WHERE doc_id % 5 <> 0 GROUP BY word ORDER BY count(*) DESC, word LIMIT 1000), n AS (SELECT count(*) AS n FROM d WHERE doc_id % 5 <> 0),
i AS (SELECT word, ln((1 + n) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM x JOIN v USING (word), n WHERE doc_id % 5 <> 0 GROUP BY word, n),
t AS (SELECT doc_id, word, count(*) * idf AS w FROM x JOIN i USING (word) GROUP BY doc_id, word, idf)
SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM t""")
def tfidf(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", clean_words(F.col("text")).alias("words"))
    return rounded(features.tfidf(d, F.col("doc_id") % 5 != 0, "doc_id", "words"))


@query("""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('4711:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    return features.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, 50 // count(*) OVER () + (row_number() OVER (ORDER BY lang) <= 50 % count(*) OVER ())::INT AS quota FROM c),
r AS (SELECT doc_id, d.lang, n, quota, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents d JOIN q USING (lang)),
t AS (SELECT *, quota // n + (k <= quota % n)::INT AS times FROM r) SELECT doc_id, lang, unnest(range(1, times + 1))::INT AS copy FROM t WHERE times > 0""")
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 50)


@query("""WITH r AS (SELECT doc_id, n_chars, sum(n_chars::DOUBLE) OVER (ORDER BY substr(md5('42:' || doc_id), 1, 2), doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(n_chars::DOUBLE) OVER () AS total FROM documents WHERE n_chars > 0),
u AS (SELECT i AS draw, (('0x' || substr(md5('42:' || i), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM range(100) t(i))
SELECT doc_id, n_chars, draw FROM u JOIN r ON u * total >= upto - n_chars AND u * total < upto""")
def weighted_sample(spark, sf_dir):
    return sampling.weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100)


@query("SELECT doc_id, (1 + 3 * toxic + quality)::INT AS weight FROM labels")
def sample_weights(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", features.sample_weight(["toxic"], ["quality"]).cast("int").alias("weight"))


@query("""SELECT 'quality' AS label, round(count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1), 6) AS pos_weight FROM labels
UNION ALL SELECT 'toxic', round(count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1), 6) FROM labels""")
def pos_weight(spark, sf_dir):
    return rounded(features.positive_weights(table(spark, sf_dir, "labels"), ["quality", "toxic"]))


@query("SELECT lang, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf_dir):
    return rounded(features.class_weights(table(spark, sf_dir, "documents"), "lang"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY 1) * 0 + dense_rank() OVER (ORDER BY lang) - 1)::INT AS lang_index FROM documents")
def encode_labels(spark, sf_dir):
    return features.encode_labels(table(spark, sf_dir, "documents"), "lang").select("doc_id", "lang_index")


@query(f"""WITH {GAPS}, u AS (SELECT event_id, event_id % 13 AS user, value, kind, test FROM e), m AS (SELECT median(value) AS m, median(user) AS mu FROM u WHERE NOT test),
k AS (SELECT kind FROM u WHERE NOT test AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
f AS (SELECT event_id, test, coalesce(value, m) AS v, coalesce(user, mu) AS u, coalesce(u.kind, k.kind) AS kind FROM u, m, k),
s AS (SELECT min(v) AS lv, max(v) - min(v) AS dv, min(u) AS lu, max(u) - min(u) AS du FROM f WHERE NOT test)
SELECT event_id, 'value' AS feature, round((v - lv) / dv, 6) AS x FROM f, s UNION ALL SELECT event_id, 'user', round((u - lu) / du, 6) FROM f, s
UNION ALL SELECT event_id, 'kind_' || l.kind, (f.kind = l.kind)::INT::DOUBLE FROM f, (SELECT DISTINCT kind FROM f WHERE NOT test) l""")
def column_transformer(spark, sf_dir):
    """Numeric and categorical columns as one array with names, fitted on the training rows; in long form."""
    e = _gaps(spark, sf_dir).withColumn("user", F.col("event_id") % 13)
    made = preparation.prepare(e, e.where("not test"), ["value", "kind", "user"], ["event_id"], "mean", "minmax")
    rows = made.rows.select("event_id", F.posexplode("features").alias("at", "x"))
    return rounded(rows.select("event_id", F.element_at(F.lit(made.names), F.col("at") + 1).alias("feature"), "x"))
