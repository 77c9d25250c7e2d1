"""The registered queries over a small folder of tables: columns, folds, SQL twins and what training may see."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import queries
from meridia.llm.oracles import ORACLES

WORD = re.compile("[^\x20\x09-\x0d]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
COLUMNS = {
    "op1_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_licences": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op5_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_class_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_pieces": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}
FOLDS = {"op6_toxicity": (4, 2), "op7_class_lm": (7, 2), "op10_language_id": (5, 0)}


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = np.random.default_rng(8)
    letters = {"en": "aeorstnh", "de": "äeumkchz"}
    vocabulary = {lang: ["".join(rng.choice(list(a), rng.integers(2, 7))) for _ in range(150)] for lang, a in letters.items()}
    docs, labels = [], []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        words = list(rng.choice(vocabulary[lang], 50))
        toxic = i % 4 == 1
        if toxic:
            words[3:40:6] = ["nastiness", "vileperson"] * 3 + ["nastiness"]
        if i % 10 == 0:
            words[20:20] = ["All", "rights", "reserved", "CC", "BY", "cc", "by"]
        docs.append((i, " ".join(words), lang, f"src{i % 4}", 0))
        labels.append((i, int(i % 2), int(toxic)))
    docs += [(200 + i, docs[i][1] + f" ende{i}", docs[i][2], "src1", 0) for i in range(12)]  # near copies
    docs += [(300 + i, docs[5][1].replace(" ", " \n"), "en", None, 0) for i in range(6)]  # exact copies but for blanks
    docs += [(400, None, "en", "src0", 0), (401, "", None, "src0", 0), (402, "12 34 !", "en", "src2", 0), (403, "zwei Worte", "de", "src9", 0)]
    return docs, labels


def written(spark, folder, docs, labels) -> str:
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("tables"), *corpus())


@pytest.fixture(scope="module")
def results(spark, sf):
    """Rows of every query by document id, each run once."""
    held = {}

    def of(name):
        if name not in held:
            found = queries.QUERIES[name](spark, sf)
            held[name] = found.dtypes, {r.doc_id: r for r in found.collect()}
        return held[name]

    return of


def in_fold(doc_id, name):
    folds, fold = FOLDS[name]
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_document_has_its_row_and_columns(results, name):
    kinds, rows = results(name)
    wanted = [tuple(c.strip().split()) for c in COLUMNS[name].split(",")]
    assert set(wanted) <= set(kinds)
    assert sorted(rows) == sorted(d[0] for d in corpus()[0])
    if name in FOLDS:
        assert all(r.held_out == in_fold(i, name) for i, r in rows.items())
    if "score" in dict(kinds) and name != "op7_class_lm":
        assert all(0 <= r.score <= 1 for r in rows.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(results, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    kinds, rows = results(name)
    assert sorted(names) == sorted(c for c, _ in kinds)
    for want in found.fetchall():
        want = dict(zip(names, want))
        got = rows[want["doc_id"]].asDict()
        assert all(math.isclose(got[c], v, rel_tol=1e-9) if isinstance(v, float) else got[c] == v for c, v in want.items()), (got, want)


def test_licence_base_columns(results):
    _, rows = results("op4_licences")
    for i, text, *_ in corpus()[0]:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
        places = [(k, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        starts, labels = [k for k, _ in places], ",".join(sorted({x for _, x in places}))
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), labels)
        assert {x for x in labels.split(",") if x} <= set(r.labels.split(","))


def test_fingerprints_of_edits(results):
    _, rows = results("op1_fingerprints")
    docs = [(i, t or "") for i, t, *_ in sorted(corpus()[0])]
    by_text = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint


def test_class_lm_base_comes_from_training_rows_alone(results):
    _, rows = results("op7_class_lm")
    docs = corpus()[0]
    counts = Counter(w for i, t, *_ in docs if not in_fold(i, "op7_class_lm") for w in [*WORD.findall(low(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, text, *_ in docs:
        words = [*WORD.findall(low(text)), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, base, abs_tol=1e-6) and r.score < 0


def test_held_out_rows_never_reach_training(spark, results, tmp_path):
    docs, labels = corpus()
    turned = {"en": "de", "de": "en", None: "de"}
    docs = [(i, t, turned[g] if in_fold(i, "op10_language_id") else g, s, n) for i, t, g, s, n in docs]
    labels = [(i, q, 1 - t if in_fold(i, "op6_toxicity") else t) for i, q, t in labels]
    sf = written(spark, tmp_path, docs, labels)
    for name in ("op6_toxicity", "op10_language_id"):
        again = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
        assert again == results(name)[1], name


def test_held_out_quality(results):
    _, toxic = results("op6_toxicity")
    _, langs = results("op10_language_id")
    docs, labels = corpus()
    held = [(i, t) for i, _, t in labels if in_fold(i, "op6_toxicity")]
    assert sum(toxic[i].predicted == t for i, t in held) >= 0.9 * len(held)
    plain = [(i, g) for i, t, g, *_ in docs if in_fold(i, "op10_language_id") and g and any(c.isalpha() for c in t or "")]
    assert sum(langs[i].lang_pred == g for i, g in plain) >= 0.95 * len(plain)
    assert all(langs[i].lang_pred == "und" for i in (400, 401, 402))


def test_near_copies_share_a_component(results):
    _, rows = results("op9_ngram_join")
    assert all(rows[200 + i].component_id == i for i in range(12) if i != 5)
    assert {rows[300 + i].component_id for i in range(6)} == {5} and rows[400].component_id == 400
