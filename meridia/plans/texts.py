"""Text cleaning, answer parsing, explanation scores, fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as tx
from ..operators import matching, metrics, profiling, prompts, textscore
from .registry import query, rounded, table

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)
CLEAN = rf"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({{t}}), '\S*https?:\S*', '', 'g'), '[^a-zA-Z\s]', '', 'g'), '\s+'),
  lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w))"""


@query(f"SELECT doc_id, array_to_string({CLEAN.format(t='text')}, ' ') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(r"SELECT page_id, regexp_replace(url || ' ' || html, '\S*https?:\S*', '', 'g') AS stripped FROM pages")
def strip_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_urls(F.concat_ws(" ", "url", "html")).alias("stripped"))


@query(r"""WITH p AS (SELECT p_partkey, p_name AS a, p_type || ' ' || p_name || ' ' || p_brand || ' ' || p_type AS b FROM part)
SELECT p_partkey, trim(a || ' ' || array_to_string(list_filter(string_split(b, ' '), lambda w: NOT list_contains(string_split(lower(a), ' '), lower(w))), ' ')) AS combined FROM p""")
def combine_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.combine_texts(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", "p_brand", "p_type")).alias("combined"))


@query("SELECT p_partkey, regexp_replace(p_brand || '/' || p_name, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM part")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.safe_filename(F.concat_ws("/", "p_brand", "p_name")).alias("name"))


@query()
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query(r"SELECT doc_id, n::BIGINT AS n_tokens FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS n FROM documents)")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.unicode_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(rf"""WITH w AS (SELECT l.quality, unnest({CLEAN.format(t='d.text')}) AS word FROM labels l JOIN documents d USING (doc_id))
SELECT quality, word, count(*) AS n FROM w GROUP BY ALL""")
def class_word_freq(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    words = docs.select("quality", tx.clean_words(F.col("text")).alias("words"))
    return profiling.word_counts(words, "words", ["quality"])


@query(r"SELECT page_id, nullif(regexp_extract(url || ' ' || html, '\b(20\d{2}|19\d{2})\b', 1), '') AS year FROM pages")
def first_year(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.first_year(F.concat_ws(" ", "url", "html")).alias("year"))


#: Answers in every form models give, from the labels.
ANSWERS_SQL = """a AS (
  SELECT doc_id, quality, toxic, CASE doc_id % 7
    WHEN 0 THEN '{"shaming": ' || (quality = 1)::VARCHAR || ', "violence": ' || (toxic = 1)::VARCHAR || '}'
    WHEN 1 THEN 'Answer: {"shaming": 0.' || (doc_id % 10)::VARCHAR || ', "stereotype": "true"} done'
    WHEN 2 THEN 'none' WHEN 3 THEN 'Shaming, violence' WHEN 4 THEN '   ' WHEN 5 THEN 'I cannot say' ELSE '{"shaming": ye, and stereotype applies' END AS answer
  FROM labels
)"""


def _answers(spark, sf_dir):
    k = F.col("doc_id") % 7
    flag = lambda c: (F.col(c) == 1).cast("string")
    answer = (
        F.when(k == 0, F.concat(F.lit('{"shaming": '), flag("quality"), F.lit(', "violence": '), flag("toxic"), F.lit("}")))
        .when(k == 1, F.concat(F.lit('Answer: {"shaming": 0.'), (F.col("doc_id") % 10).cast("string"), F.lit(', "stereotype": "true"} done')))
        .when(k == 2, "none").when(k == 3, "Shaming, violence").when(k == 4, "   ").when(k == 5, "I cannot say").otherwise('{"shaming": ye, and stereotype applies')
    )
    return table(spark, sf_dir, "labels").withColumn("answer", answer)


@query(f"""WITH {ANSWERS_SQL}
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN quality WHEN 1 THEN (doc_id % 10 >= 5)::INT WHEN 3 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS shaming,
       CASE doc_id % 7 WHEN 6 THEN 1 ELSE 0 END AS stereotype, 0 AS objectification,
       CASE doc_id % 7 WHEN 0 THEN toxic WHEN 3 THEN 1 ELSE 0 END AS violence FROM a""")
def extract_subtypes(spark, sf_dir):
    found = _answers(spark, sf_dir).withColumn("f", parsing.extract_subtypes(F.col("answer")))
    return found.select("doc_id", *[F.col("f")[i].alias(n) for i, n in enumerate(("shaming", "stereotype", "objectification", "violence"))])


@query(f"""WITH {ANSWERS_SQL}
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN quality WHEN 1 THEN (doc_id % 10 >= 5)::INT ELSE 0 END AS shaming, CASE doc_id % 7 WHEN 0 THEN toxic ELSE 0 END AS violence FROM a""")
def extract_joint(spark, sf_dir):
    found = _answers(spark, sf_dir).withColumn("f", parsing.extract_joint(F.col("answer")))
    return found.select("doc_id", F.col("f")[1].alias("shaming"), F.col("f")[4].alias("violence"))


@query(f"""WITH {ANSWERS_SQL}, s AS (
  SELECT CASE WHEN trim(answer) = '' THEN 'empty' WHEN regexp_matches(answer, '\\{{[^{{}}]*\\}}') THEN 'json' WHEN answer = 'none' THEN 'none'
         WHEN regexp_matches(lower(answer), '\\b(shaming|stereotype|objectification|violence)\\b') THEN 'labels' ELSE 'unparseable' END AS status FROM a)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def parse_status(spark, sf_dir):
    status = parsing.parse_status(F.col("answer")).alias("status")
    return _answers(spark, sf_dir).select(status).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ANSWERS_SQL}
SELECT quality, round(avg(contains(lower(answer), 'i cannot')::INT), 6) AS refusal_rate, round(avg((doc_id % 7 IN (4, 5))::INT), 6) AS no_answer_rate,
       round(avg((doc_id % 7 IN (4, 5))::INT), 6) AS parse_failure_rate, 0.5::DOUBLE AS avg_latency_s FROM a GROUP BY quality""")
def failure_rates(spark, sf_dir):
    a = _answers(spark, sf_dir)
    status = parsing.parse_status(F.col("answer"))
    rows = a.select("quality", F.when(~status.isin("empty", "unparseable"), 1).alias("pred"), parsing.is_refusal(F.col("answer")).alias("refusal"), parsing.is_parse_failure(F.col("answer")).alias("parse_failure"), F.lit(0.5).alias("latency_s"))
    return rounded(metrics.rates(rows, ["quality"]))


REFUSALS = ", ".join("'" + p.replace("'", "''") + "'" for p in tx.REFUSAL_PHRASES)


@query(f"SELECT role, count(*) AS n, count(*) FILTER (WHERE len(list_filter([{REFUSALS}], lambda p: contains(lower(coalesce(text, '')), p))) > 0) AS refusals FROM conversations GROUP BY role")
def refusals_by_role(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(parsing.is_refusal(F.col("text"))).alias("refusals"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(lower(t), '\bring\b') THEN 'ring' ELSE NULL END AS word,
       CASE WHEN regexp_matches(lower(t), '\bstandard\b') THEN 'STANDARD' WHEN regexp_matches(lower(t), '\beconomy\b') THEN 'ECONOMY' WHEN regexp_matches(lower(t), '\bsmall\b') THEN 'small'
            WHEN contains(lower(t), 'standard') THEN 'STANDARD' WHEN contains(lower(t), 'economy') THEN 'ECONOMY' WHEN contains(lower(t), 'small') THEN 'small' END AS parsed
FROM (SELECT p_partkey, 'It is ' || p_name || ' of ' || p_type || '.' AS t FROM part)""")
def parse_prediction(spark, sf_dir):
    answer = F.concat(F.lit("It is "), "p_name", F.lit(" of "), "p_type", F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", parsing.extract_label(answer, ["ring"]).alias("word"), parsing.parse_prediction(answer, ["small", "ECONOMY", "STANDARD"]).alias("parsed"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality = 1 WHEN doc_id % 3 = 1 THEN toxic = 1 ELSE NULL END AS verdict,
       CASE WHEN doc_id % 3 = 0 THEN 'because ' || doc_id WHEN doc_id % 3 = 1 THEN NULL ELSE 'free text' END AS explanation FROM labels""")
def parse_verdict(spark, sf_dir):
    k = F.col("doc_id") % 3
    flag = lambda c: (F.col(c) == 1).cast("string")
    a = F.when(k == 0, F.concat(F.lit('So: {"misogynous": '), flag("quality"), F.lit(', "explanation": "because '), F.col("doc_id"), F.lit('"}')))
    a = a.when(k == 1, F.concat(F.lit('{"misogynous": "'), flag("toxic"), F.lit('"}'))).otherwise("free text")
    found = table(spark, sf_dir, "labels").select("doc_id", parsing.parse_verdict(a).alias("v"))
    return found.select("doc_id", "v.*")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END AS yes_no, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS word,
       '{"quality":' || (quality = 1)::VARCHAR || ',"toxic":' || (toxic = 1)::VARCHAR || '}' AS target FROM labels""")
def targets(spark, sf_dir):
    said = F.when(F.col("doc_id") % 4 == 0, "perhaps").otherwise(F.concat(F.lit(" "), F.upper(tx.label_word(F.col("quality")))))
    return table(spark, sf_dir, "labels").select("doc_id", tx.yes_no(said).alias("yes_no"), tx.label_word(F.col("quality")).alias("word"), prompts.json_target(["quality", "toxic"]).alias("target"))


@query("""SELECT p_partkey, 'The item: ' || p_type AS enriched FROM part WHERE FALSE
UNION ALL SELECT p_partkey, CASE WHEN lower(p_type) IN ('economy', 'small') THEN 'cheap one ' || p_type ELSE p_type END FROM part""")
def enriched_labels(spark, sf_dir):
    entries = [("Economy", ["small"], "s", "old", None, None, 0), ("ECONOMY", ["SMALL", "tiny"], "s", "cheap one", None, None, 1), ("promo", [], "other", "elsewhere", None, None, 2)]
    catalogue = spark.createDataFrame(entries, "name string, aliases array<string>, subset string, description string, source_url string, license string, ordinal int")
    labels = table(spark, sf_dir, "part").select("p_partkey", F.lit("s").alias("subset"), F.col("p_type").alias("label"))
    return prompts.enriched_labels(labels, catalogue).select("p_partkey", "enriched")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'This item contains the text: \"' || lang || '\". Q?' ELSE 'Q?' END AS prompt FROM labels JOIN documents USING (doc_id)")
def transcript_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return d.select("doc_id", prompts.with_transcript(F.lit("Q?"), F.when(F.col("quality") == 1, F.col("lang"))).alias("prompt"))


PAIRS = """p AS (
  SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[\\p{L}\\p{N}\\p{M}_]+') AS r, regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}\\p{M}_]+') AS h
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'
)"""


def _turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"])


GRAMS = ", ".join(
    f"{s}{n} AS (SELECT conv_id, turn, g, count(*) AS k FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len({s}) - {n} + 2), lambda i: array_to_string({s}[i:i + {n} - 1], ' '))) AS g FROM p) GROUP BY ALL)"
    for n in range(1, 5)
    for s in "rh"
)
MATCHES = ", ".join(f"m{n} AS (SELECT h{n}.conv_id, h{n}.turn, sum(least(h{n}.k, coalesce(r{n}.k, 0))) AS c, sum(h{n}.k) AS t FROM h{n} LEFT JOIN r{n} USING (conv_id, turn, g) GROUP BY 1, 2)" for n in range(1, 5))
BLEU = f"""WITH {PAIRS}, {GRAMS}, {MATCHES}, l AS (
  SELECT conv_id, turn, len(r) AS nr, len(h) AS nh, {', '.join(f'ln((coalesce(m{n}.c, 0) + 0.1) / (greatest(coalesce(m{n}.t, 0), 1) + 0.1)) AS l{n}' for n in range(1, 5))}
  FROM p {' '.join(f'LEFT JOIN m{n} USING (conv_id, turn)' for n in range(1, 5))}
), b AS (
  SELECT conv_id, turn, CASE WHEN nr = 0 OR nh = 0 THEN 0 ELSE CASE WHEN nh > nr THEN 1 ELSE exp(1 - nr / nh) END END AS bp, l1, (l1 + l2 + l3 + l4) / 4 AS l FROM l
), s AS (SELECT conv_id, turn, bp * exp(l1) AS bleu_1, bp * exp(l) AS bleu_4 FROM b)"""


@query(f"{BLEU} SELECT conv_id, turn, round(bleu_1, 6) AS bleu_1, round(bleu_4, 6) AS bleu_4 FROM s")
def bleu(spark, sf_dir):
    return rounded(textscore.bleu(_turn_pairs(spark, sf_dir), "ref", "hyp").select("conv_id", "turn", "bleu_1", "bleu_4"))


@query(f"{BLEU} SELECT count(*) AS n, round(avg(bleu_1), 6) AS bleu_1_mean, round(stddev_pop(bleu_1), 6) AS bleu_1_std, round(avg(bleu_4), 6) AS bleu_4_mean, round(stddev_pop(bleu_4), 6) AS bleu_4_std FROM s")
def explanation_summary(spark, sf_dir):
    return rounded(textscore.score_summary(textscore.bleu(_turn_pairs(spark, sf_dir), "ref", "hyp"), ["bleu_1", "bleu_4"], []))


@query()
def rouge_l(spark, sf_dir):
    return rounded(textscore.rouge_l(_turn_pairs(spark, sf_dir), "ref", "hyp").select("conv_id", "turn", "lcs", "rouge_l"))


TITLE_STOP = ", ".join(f"'{w}'" for w in tx.TITLE_STOP_WORDS)
TOKENS = rf"""list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({{t}}), '[^a-z0-9\s-]', ' ', 'g'), '[\s_-]'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')),
  lambda w: length(w) > 1 AND w NOT IN ({TITLE_STOP})))"""


@query(rf"""WITH l AS (SELECT s_suppkey, s_name || ' ' || s_nationkey || ' 20' || (10 + s_nationkey) AS t FROM supplier), lt AS (SELECT s_suppkey, t, {TOKENS.format(t='t')} AS k FROM l),
r AS (SELECT c_custkey, c_name || ' ' || c_mktsegment || ' ' || c_nationkey || ' 20' || (10 + c_nationkey) AS t FROM customer), rt AS (SELECT c_custkey, t, {TOKENS.format(t='t')} AS k FROM r),
s AS (SELECT a.s_suppkey, b.c_custkey, count(*) AS shared FROM (SELECT s_suppkey, unnest(k) AS w FROM lt) a JOIN (SELECT c_custkey, unnest(k) AS w FROM rt) b USING (w) GROUP BY ALL),
f AS (SELECT s.*, shared::DOUBLE / (len(lt.k) + len(rt.k) - shared) + CASE WHEN regexp_extract(lt.t, '\b(20\d{{2}}|19\d{{2}})\b') = regexp_extract(rt.t, '\b(20\d{{2}}|19\d{{2}})\b') AND regexp_extract(lt.t, '\b(20\d{{2}}|19\d{{2}})\b') <> '' THEN 0.2 ELSE 0 END AS score
      FROM s JOIN lt USING (s_suppkey) JOIN rt USING (c_custkey)),
b AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(score, 12) DESC, c_custkey) AS rn FROM f)
SELECT s_suppkey, c_custkey AS match_id, round(score, 6) AS score, shared, CASE WHEN score >= 0.15 AND shared >= 2 THEN 'overlap' ELSE 'fallback' END AS basis FROM b WHERE rn = 1 AND score >= 0.1""")
def fuzzy_best_match(spark, sf_dir):
    year = lambda c: F.concat(F.lit(" 20"), (F.lit(10) + F.col(c)).cast("string"))
    left = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" "), "s_nationkey", year("s_nationkey")).alias("t"))
    right = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" "), "c_nationkey", year("c_nationkey")).alias("t"))
    return rounded(matching.fuzzy_best_match(left, right, "s_suppkey", "t", "c_custkey", "t"))
