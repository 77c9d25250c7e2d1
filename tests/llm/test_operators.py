import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridia.llm import class_lm, exact_dedup, fingerprints, language_id, licences, mixing, ngram_join, pieces, token_files, toxicity
from meridia.llm.common import ordered_ranges, range_bucket
from meridia.llm.components import connected_components

from .conftest import LONG, ROWS

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# fingerprints


def test_fingerprints_match_brute_force(odd):
    rows = fingerprints.fingerprint_documents(odd).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in rows) == sorted((*key(r), len(r[1] or "")) for r in ROWS)
    texts = defaultdict(set)
    for r in ROWS:
        texts[r[0]].add(r[1] or "")
    order = sorted(texts, key=lambda i: (i is not None, i or 0))
    for r in rows:
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]] | texts[r.doc_id]
        edits = {t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t in texts[r.doc_id] if len(t) == r.n_chars for n in after}
        assert r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
        assert any(r.edited_fingerprint == fingerprints.fingerprint(e) for e in edits)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_fingerprints_single_and_none(spark, nothing):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert fingerprints.fingerprint_documents(nothing).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60), st.text(max_size=20))
def test_spans_and_extensions(a, b, common):
    x, y = (fingerprints.PrefixHashes(fingerprints.code_points(t)) for t in (a + common, b + common))
    assert x.span(len(a), x.n) == y.span(len(b), y.n)
    i = 0
    while i < min(x.n, y.n) and (a + common)[i] == (b + common)[i]:
        i += 1
    assert x.common_extension(0, y) == i
    f = fingerprints.Fingerprint(x)
    assert str(fingerprints.Fingerprint.parse(str(f))) == str(f) and f.likeness(f) == 1.0


def test_likeness_tells_edits_from_strangers():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    a, b = " ".join(words[:200]), " ".join(words[200:])
    f = lambda t: fingerprints.Fingerprint(fingerprints.PrefixHashes(fingerprints.code_points(t)))
    assert 0.3 < f(a).likeness(f(a[: len(a) // 2] + b[: len(a) // 2])) < 0.7
    assert f(a).likeness(f(b)) < 0.05


def test_range_bucket(spark):
    bounds = list(range(10, 200, 7))
    got = spark.range(220).select("id", range_bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in got)


# mixing


def brute_targets(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        more = [s for s in names if s not in full and target[s] > cap * sizes[s] + 1e-9]
        if not more:
            return target
        full |= set(more)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 10, "c": 5, None: 7}, {"a": 5, "b": 4000, "c": 3000}, {"a": 0, "b": 9}])
def test_mix_targets_and_takings(spark, sizes):
    rows = [(i, " ".join(["w"] * 1), s) for s, n in sizes.items() for i in range(n)] + [(10**6, None, "a")]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, rows_per_range=50).collect()
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_odd_rows(odd, nothing):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in ROWS)
    assert mixing.mix_sources(nothing).count() == 0 == mixing.mixed_documents(nothing).count()
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix_sources(odd).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}


def test_mixed_documents_repeat_whole_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 5 else "b") for i in range(50)], "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mixed_documents(docs).collect())
    assert got["a"] == 15 and abs(got["b"] - 35) <= 1  # a is full at three times its size


# exact dedup


def test_exact_duplicates_odd(odd, nothing):
    got = exact_dedup.exact_duplicates(odd).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[hashlib.sha256(SPACE.sub(" ", r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_duplicates_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id div 2) END AS text")
    got = exact_dedup.exact_duplicates(docs, support=0.01)
    assert got.where("text_sha256 = sha2('hot', 256)").selectExpr("min(keep_id)", "min(group_size)", "sum(int(kept))").first() == (0, 1000, 1)
    assert "Python" not in got._jdf.queryExecution().toString()


# licences


def test_licence_scan_matches_brute_force(odd, nothing):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = licences.scan_licences(odd).collect()
    want = Counter((r[0], len(words.findall(low(r[1])))) for r in ROWS)
    assert Counter((r.doc_id, r.n_words) for r in got) == want
    assert licences.scan_licences(nothing).count() == 0


def test_licence_places_and_labels():
    text = "All rights reserved. CC-BY-NC 4.0; cc  by cc by\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */"
    n, base, first, last, base_labels, labels, score, free, expressions = licences.scan(text, licences.automaton())
    assert (base, first, last, base_labels) == (4, 0, 10, "cc-by,reserved")
    assert {"cc-by-nc", "spdx", "mit", "gpl-2.0-only", "apache-2.0"} <= set(labels.split(",")) and 0.9 < score <= 1
    assert expressions == ["mit gpl-2.0-only or apache-2.0 llvm-exception with and"] and free == 1.0
    assert licences.scan(None, licences.automaton())[:7] == (0, 0, None, None, "", "", 0.0)


@pytest.mark.parametrize("text, postfix", [("MIT", "mit"), ("A OR B AND C", "a b c and or"), ("(A OR B) AND C junk", "a b or c and"), ("A AND", "a"), ("( A", ""), ("OR A", "")])
def test_shunting_yard(text, postfix):
    assert " ".join(licences.to_postfix(text)) == postfix


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**17 - 1), max_size=40), max_size=8), st.integers(17, 32), st.sampled_from([8, 64]))
def test_shard_round_trip(docs, width, block):
    shard = token_files.Shard(token_files.pack_shard(list(range(len(docs))), [np.array(d, np.uint32) for d in docs], width, block))
    flat = [x for d in docs for x in d]
    assert shard.tokens(0, len(flat)).tolist() == flat
    for i, d in enumerate(docs):
        assert shard.tokens(int(shard.starts[i]), int(shard.starts[i + 1])).tolist() == d


def test_token_files_match_library(odd, nothing):
    tokenizer = Tokenizer.from_file(BPE)
    shards = token_files.write_token_shards(odd, BPE, shard_tokens=50)
    got = token_files.read_documents(shards, ("ids", "ids_crc32")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    want = defaultdict(list)
    for r in ROWS:
        want[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r.ids in want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert token_files.read_documents(token_files.write_token_shards(nothing, BPE)).count() == 0


_PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "é", "▁", "日本", "'s", "'", "\x1c", "\x85", "12", ".", "<s>", "\r\n", "\x00", "　", "ing"]), max_size=30)


@pytest.fixture(scope="module")
def codecs():
    return token_files.ByteLevelEncoder(BPE), pieces.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(parts=_PARTS)
def test_chunked_encoding_is_the_libraries(codecs, parts):
    text = "".join(parts)
    encoder, codec, library = codecs
    assert encoder(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    ids = library.encode(text)
    assert codec(text) == (",".join(map(str, ids)), library.decode(ids))


def test_pieces_odd(odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(odd, PIECES, columns=tuple(pieces.COLUMNS)).collect()
    want = Counter((r[0], tuple(library.encode(r[1] or ""))) for r in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert pieces.encode_pieces(nothing, PIECES).count() == 0


# toxicity


def toxic_corpus(n=400):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aeiourstnl"), rng.integers(3, 9))) for _ in range(500)]
    bad = ["vilething", "nastyword", "grossinsult"]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            words[5:45:8] = list(rng.choice(bad, 5))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[r[0]].predicted == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_odd(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for model in (toxicity.train(odd.select("doc_id", "text"), none), toxicity.fit([(t, y, i % 2 == 0) for i, t, y in toxic_corpus(100)])):
        assert toxicity.score_toxicity(odd, model).count() == len(ROWS)
        assert toxicity.score_toxicity(nothing, model).count() == 0


def test_toxicity_score_is_that_of_a_plain_scorer():
    """Every word and every three words in a row compressed alone, none left out beforehand."""
    model = toxicity.fit([(t, y, i % 3 == 0) for i, t, y in toxic_corpus()], toxic_sizes=(4096,), lifts=(6.0,))
    assert len(model.weights) and model.toxic != model.ordinary

    def size(content, window):
        content += toxicity.HEAD + toxicity.TAIL
        settings = zstandard.ZstdCompressionParameters.from_level(3, dict_size=2**18, source_size=256, min_match=6, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        c = zstandard.ZstdCompressor(dict_data=held, compression_params=settings)
        return len(c.compress(toxicity.HEAD + b" " + window + b" " + toxicity.TAIL))

    def gain(window):
        return size(model.ordinary, window) - size(model.toxic, window) - fixed

    strange = [size(model.ordinary, w) - size(model.toxic, w) for w in (bytes(range(1, n)) for n in range(4, 17))]
    fixed = sorted(strange)[6]

    for text in ("", None, "vilething", *[r[1] for r in toxic_corpus(8)], "Straße 7 " + "x" * 100, "a nastyword, b", "vile thing nasty word"):
        words = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", (text or "").lower()).split()
        words = [p for w in (w.encode() for w in words) for p in ([w] if len(w) <= 64 else [w[i : i + 64] for i in range(0, len(w) - 32, 32)])]
        gains = [gain(w) for w in words]
        more = [gain(b" ".join(words[i : i + 3])) for i in range(len(words)) if i == 0 or i + 3 <= len(words)]
        counts = [sum(g >= s for g in gains) for s in range(2, 9)] + [sum(g >= s for g in more) for s in (3, 4, 6, 8, 10)]
        n = len(words) + 20
        x = [1, math.log(n), *[math.log(1 + c) for c in counts], *[math.log(1 + c * 200 / n) for c in counts]]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale))
        assert model.scorer().score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_a_phrase_of_three_words_counts_at_any_offset():
    content = b" some ordinary words of no account whatever " * 3
    model = toxicity.ToxicityModel(content, b" of pure evil and more of it ", np.ones(26), np.zeros(26), np.ones(26))
    scorer = model.scorer()
    filler = [b"zq%d" % i for i in range(12)]
    none = scorer.features(b" ".join(filler).decode())
    for at in range(13):
        words = filler[:at] + [b"of", b"pure", b"evil"] + filler[at:]
        alone, running = scorer.marked(words)
        assert at in running.tolist() and set(running.tolist()) <= set(range(max(0, at - 2), min(12, at + 2) + 1))
        found = scorer.features(b" ".join(words).decode())
        assert found[2 + len(toxicity.WORD_STEPS)] > none[2 + len(toxicity.WORD_STEPS)]
    assert toxicity.running_windows([b"a", b"b"]) == [b"a b"] and len(toxicity.running_windows(filler)) == 10


# n-gram join, word hashes


def test_structured_words_hash_apart():
    """Thue-Morse words agree under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[c ^ flip] for c in bits) for flip in (0, 1))
    assert len(set(ngram_join.word_hashes(f"{a} {b} {a}").tolist())) == 2
    assert set(ngram_join.shingle_set(f"{a} w x y z").tolist()).isdisjoint(ngram_join.shingle_set(f"{b} w x y z").tolist())
    words = ["ab", "ba", "a", "aa", "aaa", "b", "A", "\x00a", "a\x00", "é", "è"]
    hashes = ngram_join.word_hashes(" ".join(words))
    assert len(hashes) == 11 and len(set(hashes.tolist())) == 10 and hashes[2] == hashes[6]
    assert (ngram_join.word_hashes("\t ab\n ba ") == hashes[:2]).all() and not len(ngram_join.word_hashes(" \n"))


# class language model


def babble(n_docs, n_words, seed=1):
    """Two made-up languages whose words are drawn by rank, in documents of one language each."""
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, n_words + 1)
    words = [[f"{'ab'[k]}{i:x}{'on'[k]}" for i in range(n_words)] for k in range(2)]
    return [" ".join(words[i % 2][j] for j in rng.choice(n_words, 120, p=p / p.sum())) for i in range(n_docs)]


def plain_scores(texts, learns, model, rare):
    """Scores by a model's classes alone: transitions and emissions counted anew, word by word."""
    n, lex = model.n_classes, model.lexicon
    known = {w: int(model.classes[i]) for i, w in enumerate(lex.words, 1)} | {w: c for w, (c, _) in rare.items()}
    ending = {e: int(model.classes[i]) for i, e in enumerate(lex.endings, 1 + len(lex.words))}
    other = int(model.classes[-1])

    def class_of(w):
        return known[w] if w in known else next((ending[w[-k:]] for k in (4, 3, 2, 1) if w[-k:] in ending), other)

    docs = [class_lm.tokens(t) for t in texts]
    counts = Counter(w for d, y in zip(docs, learns) if y for w in d)
    assert {w: n for w, (_, n) in rare.items()} == {w: n for w, n in counts.items() if w not in set(lex.words)}
    tri, mass, kinds = np.zeros((n, n, n)), np.zeros(n), np.zeros(n)
    for d, y in zip(docs, learns):
        c = [0, 0, *map(class_of, d), 0]
        if y:
            mass[0] += 1
            for x in zip(c, c[1:], c[2:]):
                tri[x] += 1
    kinds[0] = 1
    for w, k in counts.items():
        mass[known[w]] += k
        kinds[known[w]] += 1
    once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    uni = [(tri[:, :, c].sum() + 1 / n) / (tri.sum() + 1) for c in range(n)]

    def step(a, b, c):
        bi = (tri[:, b, c].sum() + 2 * uni[c]) / (tri[:, b].sum() + 2)
        return (tri[a, b, c] + 2 * bi) / (tri[a, b].sum() + 2)

    out = []
    for words in docs:
        c, total = [0, 0, *map(class_of, words), 0], 0.0
        for i, w in enumerate([*words, None]):
            a, b, own = c[i : i + 3]
            if w is None or w in counts:
                total += math.log10(step(a, b, own) * ((counts[w] if w is not None else mass[0]) - d) / mass[own])
            else:
                total += math.log10(sum(step(a, b, k) * d * kinds[k] / max(mass[k], 1) for k in range(n)))
        out.append(total)
    return out


@pytest.mark.parametrize("n_docs,n_words,n_lexicon", [(24, 60, 40), (300, 2500, 700)])
def test_class_lm_scores_match_a_plain_model(spark, n_docs, n_words, n_lexicon):
    texts = [*babble(n_docs, n_words), "never seen", "", None]
    learns = [i % 5 != 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, learns)), "doc_id long, text string, learns boolean").repartition(3)
    options = dict(n_lexicon=n_lexicon, n_classes=7, n_seed=20)
    model, rare = class_lm.train(docs.where("learns"), **options)
    table = {bytes(r.word): (r.c, r.n) for r in rare.collect()}
    assert table and len(set(model.classes.tolist())) > 2 and model.sweeps >= 1
    want = plain_scores(texts, learns, model, table)
    for got in (class_lm.score_documents(docs, model, rare), class_lm.train_and_score(docs, F.col("learns"), **options)):
        assert np.allclose([r.score for r in got.orderBy("doc_id").collect()], want, atol=1e-6)


def test_class_lm_sweeps_move_every_word_and_raise_the_likelihood(spark):
    texts = babble(400, 3000)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    model, rare = class_lm.train(docs, n_lexicon=1500, n_classes=5, n_seed=10)
    seeded, _ = class_lm.train(docs, n_lexicon=1500, n_classes=5, n_seed=10, sweeps=1)
    classes = {w: int(c) for w, c in zip(model.lexicon.words, model.classes[1:])} | {bytes(r.word): r.c for r in rare.collect()}
    assert len(classes) == len({w for t in texts for w in t.split()}) and model.sweeps > 1
    first = {w: int(c) for w, c in zip(seeded.lexicon.words, seeded.classes[1:])}
    assert any(first[w] != classes[w] for w in first)

    def value(of):
        between = np.zeros((5, 5))
        for t in texts:
            c = [0, *(of.get(w, 1) for w in class_lm.tokens(t)), 0]
            np.add.at(between, (c[:-1], c[1:]), 1)
        return class_lm.likelihood(between)

    lexicon = {w: classes[w] for w in first}
    assert value(lexicon) > value(first) and value(classes) > value(lexicon)
    # Words of one language share their classes with few words of the other.
    of = defaultdict(Counter)
    for t in texts:
        for w in class_lm.tokens(t):
            of[classes[w]][w[:1]] += 1
    assert sum(max(c.values()) for c in of.values()) > 0.95 * sum(sum(c.values()) for c in of.values())


def test_best_classes_against_the_likelihood():
    rng = np.random.default_rng(5)
    member = rng.integers(1, 4, 40)
    bigrams = rng.poisson(30, (40, 40)) * (1 + 3 * (member[:, None] == member[None, :]))
    classes = np.where(np.arange(40) == 0, 0, member)
    between = lambda c: np.array([[bigrams[np.ix_(c == i, c == j)].sum() for j in range(5)] for i in range(5)], float)
    sides = [np.array([[x[w][classes == c].sum() for c in range(5)] for w in range(40)]) for x in (bigrams.T, bigrams)]
    got = class_lm.best_classes(*sides, classes, between(classes))
    for w in range(1, 40):
        moved = [class_lm.likelihood(between(np.where(np.arange(40) == w, c, classes))) for c in range(1, 4)]
        assert got[w] == 1 + int(np.argmax(moved))


def test_class_lm_base_and_odd_rows(spark, odd, nothing):
    learned = odd.where("doc_id is null or doc_id not in (8, 10)")
    model, rare = class_lm.train(learned, n_lexicon=12, n_classes=5, n_seed=5)
    counts = Counter(w for r in ROWS if r[0] not in (8, 10) for w in [*WORD.findall(low(r[1])), None])
    total, kinds = sum(counts.values()), len(counts)
    got = class_lm.score_documents(odd, model, rare).collect()
    want = Counter()
    for r in ROWS:
        words = [*WORD.findall(low(r[1])), None]
        want[r[0], len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert np.allclose(np.power(10.0, model.log_next).sum(2), 1.0)
    assert class_lm.score_documents(nothing, model, rare).count() == 0
    none, no_words = class_lm.train(nothing)
    assert class_lm.score_documents(odd, none, no_words).count() == len(ROWS)


def test_exchange_separates_two_languages():
    bigrams = np.zeros((10, 10))
    for block in (range(1, 5), range(5, 9)):
        for i in block:
            for j in block:
                bigrams[i, j] = 5 + (i + j) % 3
    classes = class_lm.exchange(bigrams, 3)
    assert len(set(classes[1:5])) == 1 == len(set(classes[5:9])) and classes[1] != classes[5] and classes[0] == 0 and classes[9] == 3


def test_class_lm_empty(spark, nothing):
    model, rare = class_lm.train(nothing.select("text"))
    assert class_lm.score_documents(nothing, model, rare).count() == 0


# n-gram join


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    ids = defaultdict(list)
    for (i, _), c in zip(rows, label):
        ids[c].append(i)
    return Counter((i, len(s), min((x for x in ids[c] if x is not None), default=None)) for (i, _), s, c in zip(rows, sets, label))


def chained_rows():
    """Chains of edits (each links to the next, not to the first), a hot group of near copies, a passage many share."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(6):
        words = [word() for _ in range(80)]
        for _ in range(6):
            rows.append(" ".join(words))
            at = int(rng.integers(0, 70))
            words = words[:at] + [word() for _ in range(4)] + words[at + 4 :]
    hot = [word() for _ in range(100)]
    for _ in range(60):
        copy = list(hot)
        for at in rng.integers(0, 100, rng.integers(0, 4)):
            copy[at] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(int(rng.integers(5, 40)))]) for _ in range(40)]
    return [(i, t) for i, t in enumerate(rows)]


def test_join_components_match_brute_force(spark):
    rows = chained_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect())
    assert got == brute_components(rows)


def test_join_components_odd(odd, nothing):
    got = ngram_join.join_components(odd).collect()
    want = brute_components([(r[0], r[1]) for r in ROWS])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert ngram_join.join_components(nothing).count() == 0
    assert ngram_join.drop_near_duplicates(odd).columns == odd.columns


def test_near_duplicates_keep_one_row_of_each_component(spark):
    base = [f"w{i}" for i in range(60)]

    def near(group: str, last: str) -> str:
        return " ".join([*(group + w for w in base), last])

    rows = [
        (1, near("a", "x"), "kept"), (None, near("a", "y"), "copy"), (None, "a clean row that has no id either", "kept"),
        (5, near("a", "z"), "copy"), (5, "another clean text under the repeated id", "kept"),
        (7, near("b", "x"), "one of b"), (7, near("b", "y"), "one of b"), (7, near("b", "y"), "one of b"),
        (None, near("c", "x"), "one of c"), (None, near("c", "y"), "one of c"), (None, near("c", "Y"), "one of c"),
        (None, "", "kept"), (None, None, "kept"), (9, "", "kept"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, what string").repartition(3)
    got = Counter(r.what for r in ngram_join.drop_near_duplicates(docs).collect())
    assert got == {"kept": 6, "one of b": 1, "one of c": 1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(1, 30), min_size=1, max_size=20), min_size=1, max_size=8), st.sets(st.integers(1, 30), min_size=1, max_size=20))
def test_divide_skip_finds_every_link(sets, query):
    index = ngram_join.InvertedIndex([(i, len(s), np.array(sorted(s), np.uint64)) for i, s in enumerate(sets)])
    found = dict(index.search(np.array(sorted(query), np.uint64), len(query)))
    want = {i: len(s & query) for i, s in enumerate(sets) if 100 * len(s & query) >= 75 * len(s | query)}
    assert found == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(100, 101)], "a long, b long"))
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[60] == 0 and len(got) == 63


# language id


def languages(spark, n=60):
    rng = np.random.default_rng(1)
    syllables = {"xx": ["ta", "ko", "mi", "su"], "yy": ["schr", "ung", "pf", "eit"], "zz": ["oué", "eau", "ieux", "çon"]}
    rows = [(i, " ".join("".join(rng.choice(s, 3)) for _ in range(12)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_held_out_and_rejection(spark):
    docs = languages(spark)
    model = language_id.train(docs.where("doc_id % 5 <> 0"))
    got = language_id.predict_languages(docs, model).join(docs, "doc_id").where("doc_id % 5 = 0").collect()
    assert all(r.lang_pred == r.lang and not r.rejected and 0.5 < r.score <= 1 for r in got)
    alien = spark.createDataFrame([(1, "вщжъ эюя ъёщ" * 5), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert [r.rejected for r in language_id.predict_languages(alien, model).orderBy("doc_id").collect()] == [True, True, True]
    assert language_id.keep_identified(docs, model).count() == docs.count()


def test_language_id_odd(odd, nothing):
    model = language_id.train(odd.select("doc_id", "lang", "text"))
    got = language_id.predict_languages(odd, model).collect()
    assert len(got) == len(ROWS)
    blank = [r for r, s in zip(got, ROWS) if not any(c.isalpha() for c in s[1] or "")]
    assert all(r.lang_pred == "und" and r.score == 0 for r in blank) and len(blank) == 4
    untaught = language_id.train(nothing.select("doc_id", "lang", "text"))
    assert {r.lang_pred for r in language_id.predict_languages(odd, untaught).collect()} == {"und"}
    assert language_id.predict_languages(nothing, model).count() == 0


def test_kneser_ney_sums_to_one():
    counts = Counter(t[i : i + 4] for t in ("   the cat sat", "   the dog ran") for i in range(len(t) - 3))
    letters_ = sorted({c for g in counts for c in g})
    model = language_id.KneserNey(dict(counts), len(letters_))
    for context in ("", "t", "th", "the", "zzz", " ca"):
        assert sum(model.probability(context + c) for c in letters_) == pytest.approx(1.0)


def test_long_text_is_read_whole():
    assert len(ngram_join.shingle_set(LONG)) == 2 and len(language_id.letters(LONG)) == len(LONG) + 3


# ranges of ids that repeat


@pytest.mark.parametrize("kind", ["nulls", "repeated", "both", "plain", "one"])
def test_no_range_holds_all_rows_of_an_id(spark, kind):
    def name(i):
        return {"nulls": None if i % 3 == 0 else i, "repeated": 500 if i % 3 == 0 else i, "both": None if i % 3 == 0 else 7 if i % 3 == 1 else i, "plain": i, "one": 1}[kind]

    rows = [(name(i), f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = F.xxhash64("text")
    ranges = ordered_ranges(df, "doc_id", tie, 12)
    got = df.select("doc_id", tie.alias("h"), ranges.own.alias("r"), ranges.opens.alias("o"), ranges.first.alias("f")).collect()
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.r for r in got] == sorted(r.r for r in got) and {r.r for r in got} == set(range(ranges.count))
    assert max(Counter(r.r for r in got).values()) <= 900 / 12 * 2.5
    opens = [i for i in range(1, 900) if got[i].r != got[i - 1].r]
    assert all(got[i].o for i in opens) and sum(r.o for r in got) <= 3 * len(opens)
    assert got[0].f and sum(r.f for r in got) <= 2


@pytest.mark.parametrize("kind", ["nulls", "repeated"])
def test_results_with_a_third_of_the_ids_alike(spark, kind):
    same = None if kind == "nulls" else 40
    rows = [(same if i % 3 == 0 else i, f"word{i} text {'x' * (i % 7)} end{i % 11}", f"s{i % 2}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    order = [r.text for r in docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    place = {t: order[(i + 1) % 120] for i, t in enumerate(order)}
    got = fingerprints.fingerprint_documents(docs).collect()
    edited = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + place[t][: len(t) // 2]).encode()).hexdigest() for t in order)
    assert Counter(r.edited_sha256 for r in got) == edited
    tokenizer = Tokenizer.from_file(BPE)
    found = sorted(token_files.read_documents(token_files.write_token_shards(docs, BPE)).collect(), key=lambda r: r.start)
    assert [tuple(r.ids[:-1]) for r in found] == [tuple(tokenizer.encode(t, add_special_tokens=False).ids) for t in order]
    taken = mixing.mix_sources(docs, with_hash=True).collect()
    assert len({r.text_hash for r in taken}) == 120 and all(0 <= r.taken <= 3 * r.size for r in taken)
    mixed = Counter(r.text for r in mixing.mixed_documents(docs).collect())
    by = {r.text_hash: r for r in taken}
    hashed = {r.text: by[r.h] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    assert mixed == Counter({t: int(r.taken / r.size + 0.5) for t, r in hashed.items() if int(r.taken / r.size + 0.5)})
