"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart from each other: one on the words
of ordinary texts, one on the words of toxic texts that hold a run of ``GRAM``
bytes which is ``lift`` times as frequent among toxic documents as among
ordinary ones; such words are left out of the ordinary dictionary's texts.
Windows of a text, each word and every ``PHRASE`` words in a row, are compressed
with either; what the toxic dictionary saves against the ordinary one is a
window's gain.  Matches have ``GRAM`` bytes at least, so a window that shares no
run of that length with the toxic dictionary cannot gain; such windows are
recognised in one array pass and count as none.  A window stands between two
fixed frames that both dictionaries hold, and the gain of windows strange to
both is taken off, so that a block's fixed cost cancels.
A document's features are how many of its windows reach each step of gain,
absolute and for its length.  The weights that turn them into a probability are
set on documents measured with dictionaries that haven't seen them.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_table import ChunkTable
from .common import arrow_rows, clipped

#: ASCII letters are lower-cased before; letters, digits and all beyond ASCII stay.
_TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
HEAD, TAIL = b" this frame stands before each window:", b":and this one follows it."
#: A run without blanks longer than this becomes windows of this many bytes, each overlapping the next by half.
LONGEST = 64
#: Words of a running window.
PHRASE = 3
#: Bytes of the shortest match, of the runs that tell toxic words, and the least toxic training documents that hold one.
GRAM, LEAST_DOCS = 6, 4
#: zstandard's level; what matters is its shortest match.
LEVEL = 3
#: The size that zstandard sets its tables for, whatever a dictionary holds, so that both compress alike.
DICT_BOUND = 1 << 18
#: Steps of gain in bytes, for single words and for running windows.
WORD_STEPS, PHRASE_STEPS = (2, 3, 4, 5, 6, 7, 8), (3, 4, 6, 8, 10)
#: Windows compressed at once.
CHUNK = 20_000


def units(text: str | None) -> list[bytes]:
    """A text's words; a run of more than ``LONGEST`` bytes as overlapping pieces."""
    found = (text or "").lower().encode().translate(_TO_WORDS).split()
    if not any(len(w) > LONGEST for w in found):
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)]


def running_windows(words: list[bytes]) -> list[bytes]:
    """Every ``PHRASE`` words in a row; a shorter text is one window."""
    return [b" ".join(words[i : i + PHRASE]) for i in range(max(1, len(words) - PHRASE + 1))] if words else []


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    content += HEAD + TAIL
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICT_BOUND, source_size=256, min_match=GRAM, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)


def compressed_lengths(with_dictionary: zstandard.ZstdCompressor, framed: bytes, segments: bytes) -> np.ndarray:
    made = with_dictionary.multi_compress_to_buffer(zstandard.BufferWithSegments(framed, segments))
    return np.fromiter((len(m) for m in made), np.int64, len(made))


def runs_of(word: bytes) -> set[bytes]:
    """All runs of ``GRAM`` bytes of a word between blanks; a shorter word has none."""
    spaced = b" %b " % word
    return {spaced[i : i + GRAM] for i in range(len(spaced) - GRAM + 1)}


def document_counts(texts: list[list[bytes]]) -> Counter:
    """In how many texts each run occurs."""
    known: dict[bytes, set[bytes]] = {}
    counts: Counter = Counter()
    for words in texts:
        found: set[bytes] = set()
        for w in set(words):
            if w not in known:
                known[w] = runs_of(w)
            found |= known[w]
        counts.update(found)
    return counts


def train_dictionary(size: int, texts: list[list[bytes]]) -> bytes:
    """The content trained on texts given as words; the texts themselves where there are too few to train on.

    The trainer now and then gives up with hardly any content; longer segments
    are tried then.
    """
    samples = [b" %b " % b" ".join(words) for words in texts if words]
    enough = min(size, sum(map(len, samples))) // 4
    for segment in (16, 24, 32, 48):
        try:
            content = zstandard.train_dictionary(size, samples, k=segment, d=GRAM).as_bytes()
        except zstandard.ZstdError:
            break
        if len(content) >= enough:
            return content
    return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its compressors, as one worker holds them; repeated words are compressed once."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.pair = [compressor(c) for c in (model.ordinary, model.toxic)]
        self.table = ChunkTable(lambda new: self.gains(new).tolist())
        content = np.frombuffer(model.toxic + HEAD + TAIL, np.uint8)
        self.runs = np.unique(self.codes(content))

    @staticmethod
    def codes(raw: np.ndarray) -> np.ndarray:
        """One number for each run of ``GRAM`` bytes."""
        n = len(raw) - GRAM + 1
        out = np.zeros(max(0, n), np.uint64)
        for i in range(GRAM if n > 0 else 0):
            out |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        return out

    @cached_property
    def filter(self) -> np.ndarray:
        """A table of bits of the runs' hashes, looked into before the runs themselves."""
        bits = np.zeros(1 << 20, bool)
        bits[self._hash(self.runs)] = True
        return bits

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one on each window, beyond what it saves on windows strange to both."""
        return self.saved(windows) - self.fixed

    @cached_property
    def fixed(self) -> int:
        """What the dictionaries differ by on any block: the median over windows of control bytes, which no word holds."""
        return int(np.median(self.saved([bytes(range(1, n)) for n in range(4, 17)])))

    def saved(self, windows: list[bytes]) -> np.ndarray:
        out = []
        for i in range(0, len(windows), CHUNK):
            framed = [b"%b %b %b" % (HEAD, w, TAIL) for w in windows[i : i + CHUNK]]
            lengths = np.fromiter(map(len, framed), np.uint64, len(framed))
            segments = np.stack([np.cumsum(lengths) - lengths, lengths], 1).tobytes()
            whole = b"".join(framed)
            out.append(compressed_lengths(self.pair[0], whole, segments) - compressed_lengths(self.pair[1], whole, segments))
        return np.concatenate(out or [np.zeros(0, np.int64)])

    def marked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words and of the running windows that share a run with the toxic dictionary."""
        raw = np.frombuffer(b" %b " % b" ".join(words), np.uint8)
        codes = self.codes(raw)
        hit = np.flatnonzero(self.filter[self._hash(codes)])
        hit = hit[self.runs[np.minimum(np.searchsorted(self.runs, codes[hit]), len(self.runs) - 1)] == codes[hit]]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # the blank after each word
        first = np.searchsorted(ends, hit, side="right")
        last = np.searchsorted(ends, hit + GRAM - 1, side="left")
        n = max(1, len(words) - PHRASE + 1)
        opens, closes = np.maximum(0, last - PHRASE + 1), np.minimum(n - 1, first)
        inside = opens <= closes
        steps = np.bincount(opens[inside], minlength=n + 1) - np.bincount(closes[inside] + 1, minlength=n + 1)
        return np.unique(first[first == last]), np.flatnonzero(np.cumsum(steps)[:n])

    def features(self, text: str | None) -> np.ndarray:
        words = units(text)
        n = len(words) + 20
        counts = np.zeros(len(WORD_STEPS) + len(PHRASE_STEPS))
        if words:
            alone, running = self.marked(words)
            by_word = np.array(self.table([words[i] for i in alone.tolist()]), np.int64)
            by_phrase = self.gains([b" ".join(words[i : i + PHRASE]) for i in running.tolist()])
            counts[:] = [(by_word >= s).sum() for s in WORD_STEPS] + [(by_phrase >= s).sum() for s in PHRASE_STEPS]
        return np.concatenate([[1.0, math.log(n)], np.log1p(counts), np.log1p(counts * 200 / n)])

    def score(self, text: str | None) -> float:
        m = self.model
        if not len(m.weights):
            return 0.0
        z = float(((self.features(text) - m.mean) / m.scale) @ m.weights)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


_SCORERS: dict[str, Scorer] = {}


def scorer_for(model: ToxicityModel) -> Scorer:
    """The model's scorer, one a worker process, so its word table serves all the tasks that the process runs."""
    name = hashlib.sha256(b"".join([model.ordinary, b"|", model.toxic, *(a.tobytes() for a in (model.weights, model.mean, model.scale))])).hexdigest()
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = model.scorer()
    return _SCORERS[name]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps: weights, mean, scale and mean log loss."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[0], scale[0] = 0.0, 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, mean, scale, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


@dataclass
class _Fold:
    """Texts of one fold as words, by class, and how many hold each run."""

    toxic: list[list[bytes]]
    plain: list[list[bytes]]

    def __post_init__(self):
        self.among_toxic, self.among_plain = document_counts(self.toxic), document_counts(self.plain)


def dictionaries(folds: list[_Fold], lift: float, ordinary_size: int, toxic_size: int) -> ToxicityModel:
    """A model of two dictionaries trained on some folds, still without weights."""
    toxic, plain = [t for f in folds for t in f.toxic], [t for f in folds for t in f.plain]
    among_toxic, among_plain = (sum((c for c in counts), Counter()) for counts in ([f.among_toxic for f in folds], [f.among_plain for f in folds]))
    least = min(LEAST_DOCS, len(toxic))
    lifted = {g for g, n in among_toxic.items() if n >= least and n / len(toxic) > lift * (among_plain[g] + 1) / (len(plain) + 1)}
    telling = {w for texts in (toxic, plain) for words in texts for w in words}
    telling = {w for w in telling if not lifted.isdisjoint(runs_of(w))}
    ordinary = train_dictionary(ordinary_size, [[w for w in words if w not in telling] for words in plain])
    return ToxicityModel(ordinary, train_dictionary(toxic_size, [[w for w in words if w in telling] for words in toxic]))


def fit(samples: Iterable[tuple[str, int, int]], ordinary_size: int = 131_072, toxic_sizes: tuple[int, ...] = (4096, 8192), lifts: tuple[float, ...] = (6.0,)) -> ToxicityModel:
    """Fit on ``(text, toxic, fold)`` samples.

    The documents of each fold are measured with dictionaries trained on the
    other folds; these measures set the weights, and lift and size with the
    least log loss are taken.  The model's own dictionaries are then trained on
    all folds.  Without both classes outside two folds every text scores 0.
    """
    samples = list(samples)
    names = sorted({f for _, _, f in samples})
    folds = {f: _Fold([units(t) for t, y, g in samples if y and g == f], [units(t) for t, y, g in samples if not y and g == f]) for f in names}
    others = {f: [folds[g] for g in names if g != f] for f in names}
    able = [f for f in names if any(g.toxic for g in others[f]) and any(g.plain for g in others[f])]
    held = [(t, y, f) for t, y, f in samples if f in able]
    y = np.array([v for _, v, _ in held], float)
    if len(able) < 2 or len(set(y)) < 2:
        return ToxicityModel()
    tried = []
    for lift in lifts:
        for size in toxic_sizes:
            scorers = {f: dictionaries(others[f], lift, ordinary_size, size).scorer() for f in able}
            x = np.array([scorers[f].features(t) for t, _, f in held])
            weights, mean, scale, loss = fit_logistic(x, y)
            tried.append((loss, len(tried), lift, size, (weights, mean, scale)))
    _, _, lift, size, found = min(tried, key=lambda t: t[:2])
    model = dictionaries(list(folds.values()), lift, ordinary_size, size)
    model.weights, model.mean, model.scale = found
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: tuple[int, int] = (4000, 2000),
    max_chars: int = 40_000_000,
    longest: int = 1_000_000,
    folds: int = 3,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents.

    ``labels`` has ``doc_id, toxic``.  About ``per_class`` documents with label
    0 and 1, of about ``max_chars`` characters a class at most and ``longest``
    each, are chosen by a hash of their ids, which also deals them into folds.
    Rows without a label, and labels without a document, are left out; of
    several labels of an id the highest counts, and every row of a repeated id
    is a sample.  Null and empty texts are samples without a window.  Without
    both classes the model scores every text 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = clipped(docs, doc_id=id_col, text=text_col)
    sized = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).where(F.col("chars") <= longest)
    share = known.join(sized, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    most = F.when(F.col("toxic") == 1, F.lit(float(per_class[1]))).otherwise(F.lit(float(per_class[0])))
    share = share.select("toxic", F.least(F.lit(1.0), most / F.col("n"), F.lit(float(max_chars)) / F.greatest(F.col("chars"), F.lit(1))).alias("share"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6
    chosen = known.join(F.broadcast(share), "toxic").where(u < F.col("share")).select("doc_id", "toxic", F.floor(u / F.col("share") * folds).cast("int").alias("fold"))
    rows = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id")
    picked = rows.select("doc_id", "text", "toxic", "fold").collect()  # about sum(per_class) documents, 2 * max_chars characters
    picked.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([(r["text"], int(r["toxic"]), r["fold"]) for r in picked])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row, whole texts, no shuffle.

    The score lies in [0, 1]; ``predicted`` is 1 from ``threshold`` up.  Null
    and empty texts get the score of a text without a window, repeated rows
    equal scores, and an empty table gives an empty result.
    """
    rows = clipped(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_for(shared.value)
        for batch in batches:
            scores = [scorer.score(text) for (text,) in arrow_rows(batch, "text")]
            flags = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), flags], names=schema.names)

    return rows.mapInArrow(work, schema)
