"""Text functions, answer parsing and text scores."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.functions import parsing
from meridia.functions import text as tx
from meridia.operators import matching, prompts, textscore


def each(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    given_ = ["SOME Words", "  a \n line ", None, "ﬁne ①", "brand™ mark®", "→ 🐟 % & £", ""]
    assert each(spark, tx.normalize_text, given_) == ["some words", "a line", "", "fine 1", "brandtm mark®", "→ 🐟 % & £", ""]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=20), min_size=1, max_size=10))
def test_normalize_keeps_nfkc(spark, texts):
    for before, after in zip(texts, each(spark, tx.normalize_text, texts)):
        assert after == after.strip(" ") and "  " not in after
        assert len(after) <= len(unicodedata.normalize("NFKC", before).lower()) + 1


def test_clean_text(spark):
    assert each(spark, tx.clean_text, ["Visit http://x.io NOW, don't stop the 3 cats", None, " the of "]) == ["visit dont stop cats", "", ""]


def test_combine_texts(spark):
    df = spark.createDataFrame([("Hello World", "HELLO world extra extra"), ("", "x"), ("x", ""), (None, None)], "a string, b string")
    assert [r.o for r in df.select(tx.combine_texts(F.col("a"), F.col("b")).alias("o")).collect()] == ["Hello World extra extra", "x", "x", ""]


def test_small_functions(spark):
    assert each(spark, tx.safe_filename, ["YOLOv8 nano", "YOLO/v8:s"]) == ["YOLOv8_nano", "YOLO_v8_s"]
    assert each(spark, tx.parse_vector, ['"0, 1,1.0"', "", "0,,1"]) == [[0, 1, 1], [], [0, 1]]
    assert each(spark, tx.yes_no, [" YES", "no ", "perhaps", None]) == [1, 0, None, None]
    assert each(spark, tx.first_year, ["from 1999 to 2004", "12004", None]) == ["1999", None, None]
    assert each(spark, tx.text_or_placeholder, ["  ", None, "x"]) == ["empty text", "empty text", "x"]
    assert tx.source_suffix("provided", "e") == "" and tx.source_suffix("combined", "e") == "_combined_e"
    assert tx.text_source(None, True) == "ocr" and tx.task_name(" Task_B ") == "multilabel"
    for wrong in (lambda: tx.text_source("typo"), lambda: tx.task_name("typo")):
        with pytest.raises(ValueError):
            wrong()


ANSWERS = {
    '{"shaming": true, "stereotype": false, "objectification": true, "violence": false}': ([1, 0, 1, 0], "json"),
    'Answer: {"shaming": 0.9, "stereotype": 0.1, "objectification": 0.8, "violence": 0.4}': ([1, 0, 1, 0], "json"),
    "shaming, violence": ([1, 0, 0, 1], "labels"),
    "none": ([0, 0, 0, 0], "none"),
    "": ([0, 0, 0, 0], "empty"),
    "   ": ([0, 0, 0, 0], "empty"),
    '{"shaming": "true"}': ([1, 0, 0, 0], "json"),
    '{"sha': ([0, 0, 0, 0], "unparseable"),
}


def test_answers(spark):
    assert each(spark, parsing.extract_subtypes, ANSWERS) == [a for a, _ in ANSWERS.values()]
    assert each(spark, parsing.parse_status, ANSWERS) == [s for _, s in ANSWERS.values()]
    assert each(spark, parsing.extract_joint, ["not a JSON object at all", '{"misogynous": true, "violence": 1}', None]) == [[0] * 5, [1, 0, 0, 0, 1], [0] * 5]


def test_a_confident_no_is_no_failure(spark):
    said = ['{"shaming": false, "stereotype": false, "objectification": false, "violence": false}', "I cannot help with that", "", "no idea"]
    assert each(spark, parsing.is_parse_failure, said) == [False, True, True, True]
    assert each(spark, parsing.is_refusal, said) == [False, True, False, False]


def test_class_in_answer(spark):
    fn = lambda c: parsing.parse_prediction(c, ["red", "blue", "green", "dark red"])
    said = ["The color is red.", "It seems BLUE.", "This is dark red color", "reddish", "yellow color here", None]
    assert each(spark, fn, said) == ["red", "blue", "dark red", "red", None, None]
    assert each(spark, lambda c: parsing.extract_label(c, ["yes", "no"]), ['"Yes"', "well, no", "nobody"]) == ["yes", "no", None]


def test_bleu_and_rouge(spark):
    rows = [("the cat sat on the mat", "the cat on the mat"), ("a b c d e", "a b c d e"), ("", "x")]
    df = spark.createDataFrame(rows, "r string, h string")
    a, b, c = textscore.bleu(textscore.rouge_l(df, "r", "h"), "r", "h").collect()
    assert (round(a.bleu_1, 6), round(a.bleu_4, 6), a.lcs, round(a.rouge_l, 6)) == (0.818731, 0.275257, 5, 0.901305)
    assert (b.bleu_1, b.bleu_4, b.rouge_l) == (pytest.approx(1), pytest.approx(1), pytest.approx(1)) and (c.bleu_1, c.rouge_l) == (0, 0)


def test_enriched_labels(spark):
    catalogue = spark.createDataFrame(
        [("Star", ["stella"], "s", "a bright", None, None, 0), ("Star", [], "t", "another", None, None, 1)],
        "name string, aliases array<string>, subset string, description string, source_url string, license string, ordinal int",
    )
    labels = spark.createDataFrame([("s", "STELLA"), ("s", "moon"), ("t", "stella"), ("t", "star")], "subset string, label string")
    got = {(r.subset, r.label): r.enriched for r in prompts.enriched_labels(labels, catalogue).collect()}
    assert got == {("s", "STELLA"): "a bright STELLA", ("s", "moon"): "moon", ("t", "stella"): "stella", ("t", "star"): "another star"}
    assert {r.enriched for r in prompts.enriched_labels(labels, catalogue.limit(0)).collect()} == {"STELLA", "moon", "stella", "star"}


def test_fuzzy_match(spark):
    left = spark.createDataFrame([(1, "Deep learning for memes 2020"), (2, "zzz")], "l int, t string")
    right = spark.createDataFrame([(7, "deep learning of memes 2020"), (8, "learning to rank 2019")], "r int, t string")
    got = matching.fuzzy_best_match(left, right, "l", "t", "r", "t").collect()
    assert [(r.l, r.match_id, r.shared) for r in got] == [(1, 7, 4)]
