"""Language identification with interpolated Kneser-Ney character models.

Training counts character n-grams of a bounded, hash-chosen sample of labelled
documents per language.  All languages' models share one sorted array of n-gram
hashes per order with a column of log probabilities per language, so scoring a
text is a vectorised binary search and a sum.  The language with the lowest
length-normalised cross-entropy wins; a text whose cross-entropy lies above
what the language's own calibration documents reach is rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, clipped

UNDETERMINED = "und"
ORDER = 4
BLANK = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for what is no letter; built once per process."""
    if not _FOLD:
        table = np.full(0x110000, BLANK, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                table[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def letters(text: str | None) -> np.ndarray:
    """Folded code points with single blanks between words and ``ORDER - 1`` in front; empty without a letter."""
    points = fold_table()[np.frombuffer((text or "").encode("utf-32-le"), "<u4")]
    word = points != BLANK
    if not word.any():
        return np.zeros(0, np.uint32)
    keep = word.copy()
    keep[1:] |= word[:-1]
    return np.concatenate([np.full(ORDER - 1, BLANK, np.uint32), points[keep]])


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams that end at each predicted position."""
    n = len(points) - ORDER + 1
    h = np.zeros(n, np.uint64)
    for i in range(ORDER - order, ORDER):
        h = (h + points[i : i + n].astype(np.uint64) + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(29)
    return h


def hash_of(gram: str) -> int:
    pad = np.full(ORDER - len(gram), BLANK, np.uint32)
    return int(gram_hashes(np.concatenate([pad, np.array([ord(c) for c in gram], np.uint32)]), len(gram))[0])


@dataclass
class LanguageModel:
    """``hashes[k]``, ``log2p[k]``: sorted n-gram hashes of order k and their log2 probabilities per language.

    ``contexts[k]``, ``back[k]``: sorted context hashes of length k and log2 back-off weights.
    """

    languages: list[str]
    hashes: dict[int, np.ndarray]
    log2p: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    back: dict[int, np.ndarray]
    floor: np.ndarray
    scale: float = 1.0
    limits: np.ndarray | None = None

    def entropies(self, points: np.ndarray) -> np.ndarray:
        """Bits per predicted symbol under each language."""
        total = np.zeros(len(self.languages))
        n = len(points) - ORDER + 1
        left = np.arange(n)  # positions whose n-gram of the present order isn't known in any language
        for order in range(ORDER, 0, -1):
            grams = gram_hashes(points, order)[left]
            at, known = find(self.hashes[order], grams)
            total += self.log2p[order][at[known]].sum(0, dtype=np.float64)
            left = left[~known]
            if not len(left):
                break
            if order > 1:
                ends = np.concatenate([points[:1], points[:-1]])  # the context is the n-gram that ends one symbol earlier
                at, known = find(self.contexts[order - 1], gram_hashes(ends, order - 1)[left])
                total += self.back[order - 1][at[known]].sum(0, dtype=np.float64)
        return -(total + len(left) * self.floor) / n

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, confidence in [0, 1], its cross-entropy and whether it is rejected."""
        points = letters(text)
        if not len(points) or not self.languages:
            return UNDETERMINED, 0.0, None, not len(points)
        bits = self.entropies(points)
        best = int(np.argmin(bits))
        score = 1.0 / np.exp2(-(bits - bits[best]) * self.scale).sum()
        return self.languages[best], float(score), float(bits[best]), bool(self.limits is not None and bits[best] > self.limits[best])


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def sample_rows(rows: DataFrame, per_language: int, seed: int) -> DataFrame:
    """About ``per_language`` rows of each ``lang`` by a hash of the id, chosen where they stand."""
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6
    # One row a language, and the model holds a column for each: small enough to broadcast, so no text is shuffled.
    return rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("doc_id", "lang", "text", (u > F.col("share") * 0.8).alias("calibrates"))


def count_grams(sample: DataFrame) -> DataFrame:
    """``lang, gram, n`` of order ``ORDER``: counted in tasks, summed by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for lang, text in arrow_rows(batch, "lang", "text"):
                points = letters(text)
                if len(points):
                    rows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
                    grams, n = np.unique(np.ascontiguousarray(rows).view(f"V{4 * ORDER}").ravel(), return_counts=True)
                    own = counts[lang]
                    for g, k in zip(grams.tolist(), n.tolist()):
                        own[g] += k
        for lang, own in counts.items():
            grams = [bytes(g).decode("utf-32-le", "replace") for g in own]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(grams), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(work, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language."""

    def __init__(self, counts: dict[str, int], alphabet: int):
        self.counts = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):  # lower orders count distinct left neighbours
            lower: dict[str, int] = defaultdict(int)
            for gram in self.counts[order + 1]:
                lower[gram[1:]] += 1
            self.counts[order] = dict(lower)
        self.totals, self.kinds, self.discount = {}, {}, {}
        for order, own in self.counts.items():
            total, kinds = defaultdict(int), defaultdict(int)
            for gram, n in own.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            ones, twos = (sum(n == k for n in own.values()) for k in (1, 2))
            self.totals[order], self.kinds[order] = total, kinds
            self.discount[order] = ones / (ones + 2 * twos) if ones else 0.5
        self.uniform = 1.0 / alphabet

    def back_off(self, context: str) -> float:
        """Mass that the context leaves to the next lower order; all of it for an unseen context."""
        order = len(context) + 1
        if not (total := self.totals[order].get(context)):
            return 1.0
        return self.discount[order] * self.kinds[order][context] / total

    def probability(self, gram: str) -> float:
        p = self.uniform
        for order in range(1, len(gram) + 1):
            part = gram[-order:]
            if total := self.totals[order].get(part[:-1]):
                p = max(self.counts[order].get(part, 0) - self.discount[order], 0.0) / total + self.back_off(part[:-1]) * p
        return p


def build_model(counts: dict[str, dict[str, int]]) -> LanguageModel:
    """Merge per-language n-gram counts into one model; lists languages in order."""
    languages = sorted(counts)
    alphabet = len({c for own in counts.values() for g in own for c in g}) + 1
    models = [KneserNey(counts[lang], alphabet) for lang in languages]
    hashes, log2p, contexts, back = {}, {}, {}, {}

    def table(grams: set[str], value) -> tuple[np.ndarray, np.ndarray]:
        grams = sorted(grams)
        keys = np.array([hash_of(g) for g in grams], np.uint64)
        values = np.array([[np.log2(value(m, g)) for m in models] for g in grams], np.float32).reshape(len(grams), len(languages))
        order = np.argsort(keys)
        return keys[order], values[order]

    for order in range(1, ORDER + 1):
        hashes[order], log2p[order] = table({g for m in models for g in m.counts[order]}, KneserNey.probability)
        if order < ORDER:
            seen = {c for m in models for c in m.totals[order + 1]}
            contexts[order], back[order] = table(seen, KneserNey.back_off)
    unseen = np.array([np.log2(m.back_off("") * m.uniform) for m in models])
    return LanguageModel(languages, hashes, log2p, contexts, back, unseen)


def train(rows: DataFrame, per_language: int = 1000, seed: int = 11, margin: float = 2.0) -> LanguageModel:
    """Fit on rows ``doc_id, lang, text`` with known languages.

    At most about ``per_language`` documents of each language are used: four
    fifths for counts, one fifth to calibrate.  Calibration picks the
    confidence scale by log loss and sets each language's rejection limit
    ``margin`` bits above its own documents' highest cross-entropy.  Null
    languages and texts are left out, repeated rows are sampled alike, texts
    without a letter count nothing, other columns are not read, and without
    rows the model knows no language and every text is undetermined.
    """
    sample = sample_rows(rows.where("lang is not null and text is not null"), per_language, seed)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in count_grams(sample.where("not calibrates")).toLocalIterator():  # bounded by the sample
        counts[r["lang"]][r["gram"]] = r["n"]
    model = build_model(counts)
    if not model.languages:
        return model

    place = {lang: i for i, lang in enumerate(model.languages)}
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, shared.value.entropies(p).tolist()) for lang, text in arrow_rows(batch, "lang", "text") if len(p := letters(text))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([b for _, b in kept], pa.list_(pa.float64()))], names=["lang", "bits"])

    found = sample.where("calibrates").select("lang", "text").mapInArrow(measure, "lang string, bits array<double>").collect()
    found = [(place[lang], np.array(bits)) for lang, bits in found if lang in place]
    highest = np.full(len(place), max((b[i] for i, b in found), default=np.inf))
    for i in range(len(place)):
        if own := [b[i] for k, b in found if k == i and np.argmin(b) == i]:
            highest[i] = max(own)
    if found:
        truth, bits = np.array([i for i, _ in found]), np.array([b for _, b in found])
        loss = {s: -np.mean(log_share(bits, s)[np.arange(len(truth)), truth]) for s in (1.0, 2.0, 4.0, 8.0, 16.0)}
        model.scale = min(loss, key=loss.get)
    model.limits = highest + margin
    return model


def log_share(bits: np.ndarray, scale: float) -> np.ndarray:
    x = -(bits - bits.min(1, keepdims=True)) * scale
    return x - np.log2(np.exp2(x).sum(1, keepdims=True))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for every row, whole texts, no shuffle.

    A null text or one without a letter is ``und`` with score 0, null
    cross-entropy and rejected.  Ties go to the language first in order.
    """
    rows = clipped(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("lang_pred string, score double, cross_entropy double, rejected boolean").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text) for (text,) in arrow_rows(batch, "text")]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*found), kinds)]], names=schema.names)

    return rows.mapInArrow(work, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language is not rejected.

    Null and empty texts and those without a letter are rejected, repeated rows
    alike, ids don't matter, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [not shared.value.predict(text)[3] for (text,) in arrow_rows(batch, text_col)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
