"""Brown class-based n-grams: exchange clustering, class transitions, word emissions.

``log10 P(text) = sum log10 P(class | two classes before) + log10 P(word | class)``.

Every word counted in training gets its class by exchange on its own neighbours:

* Word types of bounded number, the ``lexicon`` of the most frequent words and
  the endings that stand for all rarer ones, are clustered together.  The most
  frequent start from a sequential exchange on their bigram matrix; then Spark
  sweeps count for every type the classes left and right of it over the whole
  corpus, and each moves to the class that raises the class bigrams' likelihood
  most, all against the counts of the sweep before, until a sweep no longer
  raises the likelihood.
* Every rarer word has its own row of neighbours' classes, gathered in a
  shuffle, starts in its ending's class and moves by the same rule until hardly
  any row moves.  Where a rare word is a neighbour itself it counts with its
  ending's class.
* Words never seen in training have what discounting leaves over in all classes;
  their ending's class only serves the words after them.

Lexicon, endings and class matrices are broadcast (their sizes are parameters);
all other words meet their counts and classes in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, clipped, discard, lower_az, shuffle_parts, staged

#: Type and class of a text's end.
END = 0
#: Added to the class of a word never seen, whose class only serves the words after it.
UNSEEN = 128
#: Longest ending in bytes, and the lexicon words an ending needs.
ENDING, ENDING_WORDS = 4, 5
#: Distinct words a task holds before it hands partial counts on.
FLUSH = 300_000
#: Word types whose counts one task holds together.
PER_BUCKET = 4096
#: A sweep must raise the likelihood by this share, and move this share of rare words, for another to follow.
LEAST_GAIN, LEAST_MOVED = 1e-3, 0.05


def tokens(text: str | None) -> list[bytes]:
    """Words of a text without the end token; ``bytes.split`` cuts at ASCII white space exactly."""
    return lower_az(text).split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word binary, n`` over column ``text``, with partial counts made in the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for (text,) in arrow_rows(batch, "text"):
                counts.update(tokens(text))
                if len(counts) > FLUSH:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(between: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to what no clustering changes."""
    return float(xlogx(between).sum() - xlogx(between.sum(1)).sum() - xlogx(between.sum(0)).sum())


def exchange(bigrams: np.ndarray, n_classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of the types of a bigram count matrix by sequential exchange.

    The first type is a text's end with class 0 of its own, the last stands for
    all other words with class ``n_classes``.  The rest start in turn in classes
    1 .. ``n_classes - 1``, and each sweep moves every type to the class that
    maximises the class bigrams' likelihood, until nothing moves.  Ties keep
    the lower class.
    """
    n, free, k = len(bigrams), n_classes - 1, n_classes + 1
    classes = np.array([END, *(1 + np.arange(max(0, n - 2)) % free), n_classes])[:n]
    member = np.eye(k)[classes]
    between = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(1, n - 1):
            old, self_count = classes[w], bigrams[w, w]
            right = np.bincount(classes, bigrams[w], k)
            left = np.bincount(classes, bigrams[:, w], k)
            right[old] -= self_count
            left[old] -= self_count
            between[old] -= right
            between[:, old] -= left
            between[old, old] -= self_count
            rows, cols, diag = between.sum(1), between.sum(0), np.diag(between)
            gain = (xlogx(between + right) - xlogx(between)).sum(1) + (xlogx(between.T + left) - xlogx(between.T)).sum(1)
            gain -= xlogx(diag + right) + xlogx(diag + left) - 2 * xlogx(diag)
            gain += xlogx(diag + right + left + self_count) - xlogx(diag)
            gain -= xlogx(rows + right.sum() + self_count) - xlogx(rows) + xlogx(cols + left.sum() + self_count) - xlogx(cols)
            new = 1 + int(np.argmax(gain[1:n_classes]))
            between[new] += right
            between[:, new] += left
            between[new, new] += self_count
            classes[w] = new
            moved += new != old
        if not moved:
            break
    return classes


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each row of neighbour-class counts the class that raises the likelihood most, the row's own counts taken out of its class.

    The last class, of words not placed yet, is neither chosen nor counted as a
    neighbour.  The gain is the likelihood's first-order change: each neighbour
    counts with the log of its class' share beside the class in question.
    """
    k = between.shape[0] - 1
    left, right = left[:, :k].astype(float), right[:, :k].astype(float)
    inner = between[:k, :k]
    rows, cols = between.sum(1)[:k], between.sum(0)[:k]
    smooth = 0.1
    log_right, log_left = np.log(inner + smooth), np.log(inner.T + smooth)
    n_right, n_left = right.sum(1), left.sum(1)
    gain = right @ log_right.T + left @ log_left.T - n_right[:, None] * np.log(rows + k * smooth) - n_left[:, None] * np.log(cols + k * smooth)
    at = np.flatnonzero(own < k)
    mine = own[at]
    less = lambda x: np.log(np.maximum(x, 0.0) + smooth)
    stay = (right[at] * less(inner[mine] - right[at])).sum(1) + (left[at] * less(inner.T[mine] - left[at])).sum(1)
    stay -= n_right[at] * np.log(np.maximum(rows[mine] - n_right[at], 0.0) + k * smooth) + n_left[at] * np.log(np.maximum(cols[mine] - n_left[at], 0.0) + k * smooth)
    gain[at, mine] = stay
    gain[:, END] = -np.inf
    return gain.argmax(1)


class TypeIds(dict):
    """Ids of word types: 1 .. ``n_words`` for lexicon words; any other word has its longest known ending's."""

    def __init__(self, words: list[bytes], endings: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words, 1))
        self.n_words = len(words)
        self.endings = {e: i for i, e in enumerate(endings, len(words) + 1)}

    def __missing__(self, word: bytes) -> int:
        for n in range(ENDING, 0, -1):
            if (i := self.endings.get(word[-n:])) is not None:
                return i
        return self.n_words + len(self.endings) + 1


@dataclass
class Lexicon:
    """The most frequent words with their counts, and the endings that stand for all others."""

    words: list[bytes]
    counts: np.ndarray
    endings: list[bytes]

    @property
    def n_types(self) -> int:
        return len(self.words) + len(self.endings) + 2

    def ids(self) -> TypeIds:
        return TypeIds(self.words, self.endings)


@dataclass
class ClassModel:
    lexicon: Lexicon
    classes: np.ndarray  # of types
    n_classes: int
    class_totals: np.ndarray
    class_kinds: np.ndarray
    discount: float
    n_docs: int
    n_tokens: int
    n_kinds: int
    log_next: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))  # log10 P(c | a, b)
    sweeps: int = 0

    @property
    def denominator(self) -> float:
        return float(self.n_tokens + self.n_kinds + 1)

    def emission(self, count: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of counted words by absolute discounting."""
        return np.log10((count - self.discount) / np.maximum(self.class_totals[c], 1.0))

    def log_unseen(self) -> np.ndarray:
        """log10 P(a word never seen | two classes before): what discounting left over in each class, over all classes."""
        left = np.where(self.class_kinds > 0, self.discount * self.class_kinds / np.maximum(self.class_totals, 1.0), 0.0)
        return np.log10(np.maximum(np.power(10.0, self.log_next) @ left, 1.0 / self.denominator))


def choose_lexicon(counts: DataFrame, kinds_of: dict[int, int], n_lexicon: int) -> tuple[Lexicon, int]:
    """As many whole frequency levels as ``n_lexicon`` holds, and the least frequency in it."""
    least, held = max(kinds_of, default=0) + 1, 0
    for n in sorted(kinds_of, reverse=True):
        if held + kinds_of[n] > n_lexicon:
            break
        least, held = n, held + kinds_of[n]
    top = counts.where(F.col("n") >= least).toArrow()  # at most n_lexicon rows
    ranked = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in ranked]
    endings = Counter(w[-k:] for w in words for k in range(1, min(ENDING, len(w)) + 1))
    known = sorted(e for e, n in endings.items() if n >= ENDING_WORDS)
    return Lexicon(words, np.array([n for n, _ in ranked], np.int64), known), least


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Column ``text`` as ``ids`` (packed type ids) and ``rare`` (the words outside the lexicon, in order); other columns stay."""
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("ids", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType()))])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.ids()
        for batch in batches:
            packed, rare = [], []
            for (text,) in arrow_rows(batch, "text"):
                words = tokens(text)
                ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                packed.append(ids.tobytes())
                rare.append([words[i] for i in np.flatnonzero(ids > known.n_words).tolist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(packed, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=schema.names)

    return docs.mapInArrow(work, schema)


def joined_ids(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's documents as one array of type ids, an end before and after each."""
    end = np.zeros(1, np.int32)
    return np.concatenate([end, *(x for (packed,) in arrow_rows(batch, "ids") for x in (np.frombuffer(packed, np.int32), end))])


def key_counts(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """How often each key under ``size`` occurs; ``size`` is bounded by parameters, so tasks add up whole arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(keys(batch), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["key", "n"])

    found = rows.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def class_bigrams(encoded: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    shared = encoded.sparkSession.sparkContext.broadcast(classes)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        c = shared.value[joined_ids(batch)].astype(np.int64)
        return c[:-1] * k + c[1:]

    return key_counts(encoded.select("ids"), keys, k * k).reshape(k, k)


def moved_types(encoded: DataFrame, classes: np.ndarray, between: np.ndarray) -> np.ndarray:
    """One sweep: every type's best class given all types' classes before it.

    Tasks count (side, type, neighbour's class) in one array of bounded size and
    send it on packed, in buckets of types; a task of the second stage holds a
    bucket's counts as one small matrix.
    """
    k, parts = len(between), shuffle_parts(encoded.sparkSession)
    buckets = -(-len(classes) // PER_BUCKET)
    shared = encoded.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        sides = np.zeros((2, len(of) * k), np.int32)
        for batch in batches:
            x = joined_ids(batch).astype(np.int64)
            c = of[x]
            sides[0] += np.bincount(x[1:] * k + c[:-1], minlength=len(of) * k).astype(np.int32)
            sides[1] += np.bincount(x[:-1] * k + c[1:], minlength=len(of) * k).astype(np.int32)
        sides = sides.reshape(2, len(of), k)
        pack = lambda v: zstandard.compress(v.astype("<i4").tobytes(), 1)
        rows = []
        for b in range(buckets):  # every so-manieth type, so that frequent types spread
            part = sides[:, b::buckets].reshape(-1)
            some = np.flatnonzero(part)
            if len(some):
                rows.append((b, pack(np.diff(some, prepend=0)), pack(part[some])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "steps", "counts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def rows() -> pa.RecordBatch:
            ids = np.arange(now, len(shared.value), buckets)
            left, right = total.reshape(2, len(ids), k)
            at = np.flatnonzero(left.sum(1) + right.sum(1))
            new = best_classes(left[at], right[at], shared.value[ids[at]], between)
            return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(new, pa.int64())], names=["id", "c"])

        for batch in batches:
            for bucket, steps, counts in arrow_rows(batch, "bucket", "steps", "counts"):
                if bucket != now:
                    if now is not None:
                        yield rows()
                    now, total = bucket, np.zeros(2 * k * len(range(bucket, len(shared.value), buckets)), np.int64)
                total[np.cumsum(np.frombuffer(zstandard.decompress(steps), "<i4"))] += np.frombuffer(zstandard.decompress(counts), "<i4")
        if now is not None:
            yield rows()

    blocks = encoded.select("ids").mapInArrow(count, "bucket long, steps binary, counts binary")
    found = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(choose, "id long, c long").toArrow()  # at most a row a type
    new = classes.copy()
    new[found.column("id").to_numpy()] = found.column("c").to_numpy()
    new[END] = END
    return new


def cluster_types(encoded: DataFrame, lexicon: Lexicon, n_classes: int, n_seed: int, sweeps: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Classes of all types, their class bigrams, and the sweeps it took."""
    k, seed = n_classes + 1, min(n_seed, len(lexicon.words))
    size = seed + 2

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        x = np.minimum(joined_ids(batch), seed + 1).astype(np.int64)
        return x[:-1] * size + x[1:]

    start = exchange(key_counts(encoded.select("ids"), keys, size * size).reshape(size, size), n_classes)
    classes = np.full(lexicon.n_types, n_classes, np.int16)
    classes[: seed + 1] = start[: seed + 1]
    between = class_bigrams(encoded, classes, k)
    for done in range(sweeps):
        new = moved_types(encoded, classes, between)
        new[new == n_classes] = 1  # types that no text has
        after = class_bigrams(encoded, new, k)
        gain = likelihood(after) - likelihood(between)
        if not done or gain > 0:
            classes, between = new, after
        if done and gain <= LEAST_GAIN * abs(likelihood(between)):
            return classes, between, done + 1
    return classes, between, sweeps


def rare_contexts(encoded: DataFrame, lexicon: Lexicon, classes: np.ndarray, k: int) -> DataFrame:
    """``word, c, contexts``: every word outside the lexicon with its ending's class and, packed, the classes left and right of each occurrence.

    A row has two bytes an occurrence, and no word outside the lexicon occurs more often than its rarest word.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((len(lexicon.words), classes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words, of = shared.value
        held: dict[bytes, list[int]] = {}
        first: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            out = [list(held), [first[w] for w in held], [np.array(v, "<u2").tobytes() for v in held.values()]]
            held.clear(), first.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int32(), pa.binary()))], names=["word", "c", "contexts"])

        for batch in batches:
            for packed, rare in arrow_rows(batch, "ids", "rare"):
                if not rare:
                    continue
                ids = np.frombuffer(packed, np.int32)
                c = np.concatenate([[END], of[ids], [END]]).astype(np.int64)
                at = np.flatnonzero(ids > n_words)
                for word, own, code in zip(rare, c[at + 1].tolist(), (c[at] * k + c[at + 2]).tolist()):
                    if word in held:
                        held[word].append(code)
                    else:
                        held[word], first[word] = [code], own
                if len(held) > FLUSH:
                    yield rows()
        yield rows()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.array([b"".join(parts) for (parts,) in arrow_rows(batch, "contexts")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), whole], names=["word", "c", "contexts"])

    schema = "word binary, c int, contexts binary"
    found = encoded.select("ids", "rare").mapInArrow(work, schema).groupBy("word")
    return found.agg(F.first("c").alias("c"), F.collect_list("contexts").alias("contexts")).mapInArrow(joined, schema)


def settle_rare(rare: DataFrame, between: np.ndarray, sweeps: int) -> DataFrame:
    """``word, c, n`` of rare words after they moved to their best classes, class bigrams following each sweep."""
    k = len(between)

    def step(rows: DataFrame, between: np.ndarray) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = [np.frombuffer(x, "<u2") for (x,) in arrow_rows(batch, "contexts")]
                row = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
                code = np.concatenate([np.zeros(0, np.uint16), *codes]).astype(np.int64)
                left, right = (np.bincount(row * k + side, minlength=len(codes) * k).reshape(-1, k) for side in (code // k, code % k))
                own = batch.column("c").to_numpy()
                new = best_classes(left, right, own, between)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(new, pa.int32()), batch.column("contexts"), pa.array(own, pa.int32())], names=["word", "c", "contexts", "old"])

        return rows.select("word", "c", "contexts").mapInArrow(work, "word binary, c int, contexts binary, old int")

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        """Bigrams that moved rows add to their new class and take from the old one."""
        codes = [np.frombuffer(x, "<u2") for (x,) in arrow_rows(batch, "contexts")]
        code, sizes = np.concatenate([np.zeros(0, np.uint16), *codes]).astype(np.int64), [len(x) for x in codes]
        new, old = (np.repeat(batch.column(c).to_numpy().astype(np.int64), sizes) for c in ("c", "old"))
        return np.concatenate([sign * k * k + x for sign, c in ((0, new), (1, old)) for x in ((code // k) * k + c, c * k + code % k)])

    for _ in range(sweeps):
        moved = staged(step(rare, between), "rare", compression="zstd")
        discard(rare)
        rare = moved
        share = moved.agg(F.avg((F.col("c") != F.col("old")).cast("double")).alias("x")).first()["x"] or 0.0
        if share < LEAST_MOVED:
            break
        change = key_counts(moved.where("c <> old"), keys, 2 * k * k).reshape(2, k, k)
        between = np.maximum(between + change[0] - change[1], 0.0)
    return rare.select("word", "c", (F.length("contexts") / 2).cast("long").alias("n"))


def log_transitions(trigrams: np.ndarray, prior: float = 2.0) -> np.ndarray:
    """log10 P(c | a, b), shrunk to the bigram, the unigram and the uniform distribution in turn."""
    k = len(trigrams)
    uni = trigrams.sum((0, 1))
    uni = (uni + 1.0 / k) / (uni.sum() + 1.0)
    bi = trigrams.sum(0)
    bi = (bi + prior * uni) / (bi.sum(1, keepdims=True) + prior)
    tri = (trigrams + prior * bi) / (trigrams.sum(2, keepdims=True) + prior)
    return np.log10(tri)


def place_words(encoded: DataFrame, model: ClassModel, rare: DataFrame) -> DataFrame:
    """``classes`` (one byte a token), ``n_known, base, emitted`` of every encoded document, once its rare words met their rows."""
    uses = encoded.select("row", F.posexplode("rare").alias("at", "word")).join(rare, "word")
    uses = uses.groupBy("row").agg(F.collect_list(F.struct("at", F.col("c").cast("int").alias("c"), "n")).alias("found"))
    others = [c for c in encoded.columns if c not in ("row", "ids", "rare")]
    fields = T.StructType.fromDDL("classes binary, n_known long, base double, emitted double").fields
    schema = T.StructType([*[encoded.schema[c] for c in others], *fields])
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n_words = len(m.lexicon.words)
        counts = np.concatenate([[m.n_docs], m.lexicon.counts])
        base_of, emission_of = np.log10((counts + 1) / m.denominator), m.emission(np.maximum(counts, 1), m.classes[: n_words + 1].astype(np.int64))
        for batch in batches:
            found = batch.column("found")
            sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy()
            ends = np.cumsum(sizes)
            flat = found.flatten()
            at, c, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = []
            for (packed,), end, size in zip(arrow_rows(batch, "ids"), ends.tolist(), sizes.tolist()):
                ids = np.frombuffer(packed, np.int32)
                classes = m.classes[ids].astype(np.int64)
                rare, mine = np.flatnonzero(ids > n_words), slice(end - size, end)
                times = np.zeros(len(rare), np.int64)
                times[at[mine]] = n[mine]
                classes[rare[at[mine]]] = c[mine]
                known = ids[ids <= n_words]
                base = base_of[known].sum() + np.log10((times + 1) / m.denominator).sum() + base_of[END]
                seen = rare[times > 0]
                emitted = emission_of[known].sum() + m.emission(times[times > 0], classes[seen]).sum() + emission_of[END]
                classes[rare[times == 0]] += UNSEEN
                out.append((classes.astype(np.uint8).tobytes(), len(known) + len(seen) + (m.n_docs > 0), base, emitted))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(o) for o in others], *[pa.array(v, t) for v, t in zip(zip(*out), kinds)]], names=schema.names)

    return encoded.drop("rare").join(uses, "row", "left").select(*others, "ids", "found").mapInArrow(work, schema)


def with_ends(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Classes with two ends before and one after, and the places of words never seen."""
    c = np.concatenate([[END, END], np.frombuffer(packed, np.uint8), [END]]).astype(np.int64)
    unseen = np.flatnonzero(c >= UNSEEN)
    c[unseen] -= UNSEEN
    return c, unseen


def learn_transitions(placed: DataFrame, n_classes: int) -> np.ndarray:
    def keys(batch: pa.RecordBatch) -> np.ndarray:
        each = [with_ends(packed)[0] for (packed,) in arrow_rows(batch, "classes")]
        return np.concatenate([np.zeros(0, np.int64), *((c[:-2] * n_classes + c[1:-1]) * n_classes + c[2:] for c in each)])

    return log_transitions(key_counts(placed.select("classes"), keys, n_classes**3).reshape((n_classes,) * 3))


def add_transitions(placed: DataFrame, model: ClassModel) -> DataFrame:
    shared = placed.sparkSession.sparkContext.broadcast((model.log_next, model.log_unseen()))
    others = [c for c in placed.columns if c != "classes"]
    schema = T.StructType([*[placed.schema[c] for c in others], T.StructField("n_tokens", T.LongType()), T.StructField("steps", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_next, log_unseen = shared.value
        for batch in batches:
            steps, sizes = [], []
            for (packed,) in arrow_rows(batch, "classes"):
                c, unseen = with_ends(packed)
                each = log_next[c[:-2], c[1:-1], c[2:]]
                each[unseen - 2] = log_unseen[c[unseen - 2], c[unseen - 1]]
                steps.append(float(each.sum()))
                sizes.append(len(c) - 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(o) for o in others], pa.array(sizes, pa.int64()), pa.array(steps, pa.float64())], names=schema.names)

    score = F.col("steps") + F.col("emitted")
    return placed.mapInArrow(work, schema).select(
        "doc_id", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def encoded_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    return staged(encode(docs, lexicon).withColumn("row", F.monotonically_increasing_id()), "encoded", compression="zstd")


def learn(docs: DataFrame, n_lexicon: int, n_classes: int, n_seed: int, sweeps: int) -> tuple[ClassModel, DataFrame, DataFrame]:
    """Model, rare words and placed rows of ``doc_id, text, learns``; only rows with ``learns`` are learned from."""
    if not 2 <= n_classes <= UNSEEN:
        raise ValueError(f"n_classes must lie between 2 and {UNSEEN}")
    counts = staged(count_words(docs.where("learns")), "word-counts")
    shape = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("tokens")).collect()
    kinds_of = {r["n"]: r["kinds"] for r in shape}
    n_docs = docs.where("learns").count()
    n_tokens, n_kinds = sum(r["tokens"] for r in shape) + n_docs, sum(kinds_of.values()) + (n_docs > 0)
    lexicon, _ = choose_lexicon(counts, kinds_of, n_lexicon)
    discard(counts)

    encoded = encoded_rows(docs, lexicon)
    learned = encoded.where("learns")
    classes, between, done = cluster_types(learned, lexicon, n_classes, n_seed, sweeps)
    contexts = staged(rare_contexts(learned, lexicon, classes, n_classes + 1), "rare", compression="zstd")
    rare = settle_rare(contexts, between, sweeps)

    totals, kinds = np.zeros(n_classes), np.zeros(n_classes)
    of = classes[1 : len(lexicon.words) + 1].astype(np.int64)
    totals += np.bincount(of, lexicon.counts, n_classes)
    kinds += np.bincount(of, minlength=n_classes)
    for r in rare.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        totals[r["c"]] += r["n"]
        kinds[r["c"]] += r["kinds"]
    totals[END], kinds[END] = n_docs, n_docs > 0
    ones, twos = kinds_of.get(1, 0), kinds_of.get(2, 0)
    discount = ones / (ones + 2 * twos) if ones else 0.5
    model = ClassModel(lexicon, classes, n_classes, totals, kinds, discount, n_docs, n_tokens, n_kinds, sweeps=done)
    placed = staged(place_words(encoded, model, rare), "placed", compression="zstd")
    discard(encoded)
    model.log_next = learn_transitions(placed.where("learns"), n_classes)
    return model, rare, placed


def train(docs: DataFrame, n_lexicon: int = 200_000, n_classes: int = 32, n_seed: int = 1000, sweeps: int = 6, text_col: str = "text") -> tuple[ClassModel, DataFrame]:
    """Learn from all of ``docs``: the model and ``word, c, n`` of all words outside its lexicon.

    Null and empty texts are documents of an end alone, repeated rows count as
    often as they stand there, other columns are not read, and from an empty
    table comes a model that gives every text the uniform class transitions.
    ``n_seed`` words start the clustering, which then moves all words.
    """
    rows = clipped(docs, text=text_col).select(F.lit(0).alias("doc_id"), "text", F.lit(True).alias("learns"))
    model, rare, placed = learn(rows, n_lexicon, n_classes, n_seed, sweeps)
    discard(placed)
    return model, rare


def score_documents(docs: DataFrame, model: ClassModel, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probabilities of whole texts under the model and the add-one unigram base.

    ``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity``,
    one row per input row, repeated rows included.  The end counts as a token,
    so a null or empty text has one; null ids stay null, and an empty table
    gives an empty result.
    """
    encoded = encoded_rows(clipped(docs, doc_id=id_col, text=text_col), model.lexicon)
    return add_transitions(place_words(encoded, model, rare), model)


def train_and_score(
    docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", n_lexicon: int = 200_000, n_classes: int = 32, n_seed: int = 1000, sweeps: int = 6
) -> DataFrame:
    """``score_documents`` of all rows by the model of the rows where ``learns`` holds, texts read twice in all."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    model, rare, placed = learn(rows, n_lexicon, n_classes, n_seed, sweeps)
    discard(rare)
    return add_transitions(placed, model)
