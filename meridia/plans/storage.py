"""Round trips through the sinks and sources: what is written is what a scan reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, metrics
from ..sources import readers, spreadsheets, writers
from ..sources.scratch import scratch_path
from .registry import query, rounded, table

SPLIT_NAMES = ("train", "validation", "test")


def _written_splits(spark, sf_dir) -> str:
    """The labels as three tab-separated splits by id, in order of ids; texts are the languages."""
    root = scratch_path(spark, "splits")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    for i, name in enumerate(SPLIT_NAMES):
        part = rows.where(F.col("doc_id") % 3 == i).orderBy("doc_id")
        named = part.select(
            F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".v1.jpg")).alias("file_name"), F.col("toxic").alias("label"),
            F.col("quality").alias("shaming"), (F.col("doc_id") % 2).alias("violence"), F.col("lang").alias("text"),
        )
        named.coalesce(1).write.csv(f"{root}/{name}.tsv", sep="\t", header=True, quote='"', escape='"')
    return root


SPLIT_SQL = """s AS (SELECT l.doc_id, l.doc_id || '.v1' AS image_id, coalesce(d.lang, '') AS text, toxic::INT AS label, quality::INT AS shaming, 0::INT AS stereotype, 0::INT AS objectification,
  (l.doc_id % 2)::INT AS violence, CASE l.doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM labels l JOIN documents d USING (doc_id))"""


@query(f"WITH {SPLIT_SQL} SELECT * EXCLUDE (doc_id) FROM s WHERE split <> 'test'")
def split_scan(spark, sf_dir):
    """Two splits one after another, typed; columns that the files lack count as 0."""
    return readers.read_splits(spark, _written_splits(spark, sf_dir), "train, validation")


@query(f"WITH {SPLIT_SQL} SELECT * EXCLUDE (doc_id) FROM s ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'train' THEN 1 ELSE 2 END, doc_id LIMIT 40")
def split_scan_limit(spark, sf_dir):
    """A limit counts over the splits in the order they are named, each in file order."""
    return readers.read_splits(spark, _written_splits(spark, sf_dir), "test,train", limit=40)


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, sum(label)::BIGINT AS positive FROM s GROUP BY split")
def split_manager(spark, sf_dir):
    """Splits by name, each read once and kept."""
    splits = readers.Splits(spark, _written_splits(spark, sf_dir))
    parts = [splits[name].groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive")) for name in SPLIT_NAMES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT m.model, doc_id AS row_id, toxic::INT AS actual, (CASE m.model WHEN 'rule' THEN quality ELSE (quality + toxic) % 2 END)::INT AS pred FROM labels, (SELECT unnest(['rule', 'xor']) AS model) m")
def prediction_table(spark, sf_dir):
    """Predictions written wide, read back long."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("actual"), F.col("quality").alias("rule"), ((F.col("quality") + F.col("toxic")) % 2).alias("xor"))
    path = scratch_path(spark, "predictions")
    writers.write_wide_predictions(labels.unpivot(["row_id", "actual"], ["rule", "xor"], "model", "pred"), path, ["rule", "xor"], with_row_id=True)
    return readers.read_predictions(spark, path)


@query("SELECT m.model, doc_id AS row_id, [toxic, quality]::INT[] AS actual, [quality, toxic]::INT[] AS pred FROM labels, (SELECT 'swap' AS model) m")
def multilabel_prediction_table(spark, sf_dir):
    both = F.concat_ws(",", F.col("toxic"), F.col("quality")).alias("actual"), F.concat_ws(",", F.col("quality"), F.col("toxic")).alias("pred")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), *both, F.lit("swap").alias("model"))
    path = scratch_path(spark, "predictions")
    writers.write_wide_predictions(rows, path, ["swap"], with_row_id=True)
    return readers.read_predictions(spark, path, multilabel=True)


@query("""SELECT event_type AS model, round(avg(value), 6) AS f1, 'none' AS filter FROM events WHERE event_id % 2 = 0 GROUP BY event_type""")
def result_files(spark, sf_dir):
    """One result file a model with a filtered and an unfiltered row; the unfiltered one is taken."""
    events = table(spark, sf_dir, "events").withColumn("filter", F.when(F.col("event_id") % 2 == 0, "none").otherwise("blur"))
    rows = events.groupBy(F.col("event_type").alias("model"), "filter").agg(F.avg("value").alias("f1"))
    path = scratch_path(spark, "results")
    rows = rows.withColumns({"split": F.lit("test"), "task": F.lit("binary")})
    writers.write_results(rows.repartition("model").sortWithinPartitions("model", "filter"), path)
    found = [readers.read_result_lines(spark, path)]
    return rounded(found[0].select("model", "f1", "filter"))


@query("""SELECT 'v' || vec_id AS image_id, label::INT AS target, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x : x::DOUBLE)), 4) AS total FROM embeddings""")
def embedding_files(spark, sf_dir):
    """Image and text halves written as two tables, read back as one prepared split."""
    e = table(spark, sf_dir, "embeddings")
    bundle = e.select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("image_id"), F.slice("embedding", 1, 32).alias("img_emb"), F.slice("embedding", 33, 32).alias("txt_emb"), F.col("label").cast("int").alias("label"))
    parts = []
    for keep in (F.col("vec_id") % 5 != 0, F.col("vec_id") % 5 == 0):
        path = scratch_path(spark, "embeddings")
        writers.write_embeddings(bundle.where(keep).drop("vec_id"), path)
        parts.append(readers.read_embeddings(spark, path))
    rows = readers.prepared_split(*parts)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(rows.select("image_id", "target", "split", F.size("vector").alias("width"), total.alias("total")), 4)


@query("""SELECT n_name AS "Model", round(avg(s_acctbal), 4) AS "F1" FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def ranked_file(spark, sf_dir):
    """A ranked table written as one CSV and read by its extension."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("Model")).agg(F.round(F.avg("s_acctbal"), 4).alias("F1"))
    path = scratch_path(spark, "ranked") + ".csv"
    writers.write_ranked(rows, path, "F1")
    return readers.read_table(spark, path, columns=["Model", "F1"])


@query("SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL")
def json_lines(spark, sf_dir):
    path = scratch_path(spark, "lines") + ".jsonl"
    writers.write_json_lines(table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", "text"), path)
    return readers.read_table(spark, path, columns=["conv_id", "turn", "role", "text"])


@query("SELECT quality, count(*) AS n, round(avg(toxic), 6) AS toxic_share FROM labels GROUP BY quality")
def report_file(spark, sf_dir):
    """A profile written as a sorted CSV."""
    rows = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_share"))
    path = scratch_path(spark, "report") + ".csv"
    writers.write_table(rows, path, ["quality"])
    found = readers.read_table(spark, path)
    return found.select(F.col("quality").cast("int").alias("quality"), F.col("n").cast("long").alias("n"), F.col("toxic_share").cast("double").alias("toxic_share"))


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, round(s_acctbal, 2) AS s_acctbal, s_acctbal > 0 AS positive, CASE WHEN s_suppkey % 3 > 0 THEN s_name || ' <&> ' || chr(233) END AS note FROM supplier")
def excel_scan(spark, sf_dir):
    """A table written as a workbook and read by its extension, typed by its cells."""
    key = F.col("s_suppkey")
    note = F.when(key % 3 > 0, F.concat("s_name", F.lit(" <&> é")))
    rows = table(spark, sf_dir, "supplier").select(key.cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), F.round(F.col("s_acctbal").cast("double"), 2).alias("s_acctbal"), (F.col("s_acctbal") > 0).alias("positive"), note.alias("note"))
    path = scratch_path(spark, "book") + ".xlsx"
    spreadsheets.write_excel(rows, path, order=["s_suppkey"])
    return readers.read_table(spark, path)


@query("SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL")
def annotation_classes(spark, sf_dir):
    return readers.read_annotations(table(spark, sf_dir, "documents"), "doc_id", "lang")[1]


@query("SELECT s_name AS \"Model\", s_acctbal AS score FROM supplier WHERE s_suppkey = 7")
def evaluation_lookup(spark, sf_dir):
    """The first row of a table for a name, blanks around it aside."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("Model"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("ordinal"))
    name = rows.where("ordinal = 7").select(F.trim("Model")).first()[0]
    return readers.evaluation_row(rows, name, "ordinal").select(F.trim("Model").alias("Model"), "score")


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND value > 0.25 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def filter_chain(spark, sf_dir):
    """Target and text present, confident enough, and in a group of ids."""
    events = table(spark, sf_dir, "events")
    target = F.when(F.col("event_type").isin("click", "view"), F.col("event_type"))
    rows = filters.with_target(events.withColumn("target", target), "target", "props")
    rows = rows.where(filters.has_detection(F.array(F.struct(F.col("value").alias("confidence"))), 0.25) & (F.col("value") > 0.25))
    return filters.in_group(rows, events.where("event_type = 'purchase'"), "user_id").select("event_id", "user_id", "value")


@query("""WITH r AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE round(o_totalprice, 2)::VARCHAR END AS x, CASE o_orderstatus WHEN 'F' THEN 'FAILED: x' ELSE 'OK' END AS status,
  CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS origin, o_orderpriority AS mode, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bin FROM orders)
SELECT row, round(x::DOUBLE, 2) AS x FROM r WHERE status = 'OK' AND x <> 'N/A' AND origin = 'a' AND mode LIKE '1%' AND bin""")
def ranked_rows_only(spark, sf_dir):
    """Runs that failed, printed metrics that are no numbers, other origins and other modes don't rank."""
    number, key = F.round("o_totalprice", 2).cast("string"), F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        key.alias("row"), F.when(key % 5 == 0, "N/A").otherwise(number).alias("x"), F.when(F.col("o_orderstatus") == "F", "FAILED: x").otherwise("OK").alias("status"),
        F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("origin"), F.substring("o_orderpriority", 1, 1).alias("mode"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("binary"),
    )
    rows = filters.of_mode(filters.of_origin(filters.ranked_rows(runs, "x"), "a", "x"), mode="1", binary=True)
    return rows.select("row", F.round(F.col("x").cast("double"), 2).alias("x"))


@query("SELECT doc_id, quality AS pred, toxic AS gt FROM labels")
def strict_pairs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return filters.pair_strictly(labels.select("doc_id", F.col("quality").alias("pred")), labels.select("doc_id", F.col("toxic").alias("gt")), "doc_id")


RANKS = """x AS (SELECT c.k AS label, (('0x' || substr(md5(o_orderkey || ':' || c.k), 1, 6))::BIGINT % 50)::DOUBLE AS score, (o_orderkey % 3 = c.k)::INT AS gt FROM orders, (SELECT unnest([0, 1, 2]) AS k) c),
k AS (SELECT label, score, sum(gt) AS p, sum(1 - gt) AS q FROM x GROUP BY label, score),
w AS (SELECT label, p, q, coalesce(sum(q) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM k),
a AS (SELECT label, sum(p * (under + q / 2.0)) / (sum(p) * sum(q))::DOUBLE AS auc FROM w GROUP BY label)"""


@query(f"WITH {RANKS} SELECT round(avg(auc), 6) AS roc_auc, count(*) AS n_labels FROM a")
def one_vs_rest_auc(spark, sf_dir):
    """Three classes, each scored by a hash, against the rest."""
    part = lambda k: (F.conv(F.substring(F.md5(F.concat_ws(":", "o_orderkey", F.lit(k))), 1, 6), 16, 10).cast("long") % 50).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[part(k) for k in range(3)]).alias("scores"), (F.col("o_orderkey") % 3).cast("int").alias("gt"))
    return rounded(metrics.one_vs_rest_auc(metrics.class_scores_long(rows, "scores", [0, 1, 2], "gt").drop("o_orderkey"), []))


@query("""WITH c AS (SELECT role, count(*) FILTER (WHERE contains(lower(coalesce(text, '')), 'i cannot')) AS refused, count(*) AS n FROM conversations GROUP BY role)
SELECT role, refused, n, round(refused / sum(n) OVER (), 6) AS share_of_all, round(refused / n, 6) AS refusal_rate FROM c""")
def refusal_by_category(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("i cannot")).alias("refusal"))
    return rounded(metrics.refusal_by_category(rows, "role"))


@query("SELECT event_type, round(avg(value), 6) AS avg_latency_s, round(avg(value) / 4, 6) AS avg_latency_per_label_s FROM events GROUP BY event_type")
def mean_latency(spark, sf_dir):
    return rounded(metrics.mean_latency(table(spark, sf_dir, "events").withColumnRenamed("value", "latency_s"), ["event_type"], 4))


SWEEP = """c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn,
  count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) AS n FROM labels)"""


@query(f"""WITH {SWEEP} SELECT 'rule' AS model, round((tp + tn) / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  tp, fn, fp, tn, round(fp / (fp + tn), 6) AS fp_rate, round(fn / (fn + tp), 6) AS fn_rate FROM c""")
def sweep_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.lit("rule").alias("model"), F.col("quality").alias("pred"), F.col("toxic").alias("gt"))
    return rounded(metrics.sweep_metrics(rows, [0, 1], ["model"]))
