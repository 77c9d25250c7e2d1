"""Document fingerprints from prefix polynomial hashes.

Modular prefix sums ``H[i] = sum (c[j] + 1) * B^j`` over a text's code points
answer the equality of any two spans and, by binary search, the longest common
extension from two positions.  Two bases modulo 2^31 - 1 make a 62-bit hash.  A
fingerprint is the length, the whole text's hash and the smallest distinct
hashes of all its spans of ``SPAN`` code points, read off the prefix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, clipped, ordered_ranges, shuffle_parts

P = np.uint64(2**31 - 1)
BASES = (1_000_003, 822_616_071)
#: Code points of a span, and hashes a fingerprint keeps.
SPAN, KEPT = 12, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self):
        factors = [*BASES, *(pow(b, -1, int(P)) for b in BASES)]
        self.table, self.steps = np.ones((4, 1), np.uint64), np.array(factors, np.uint64)[:, None]

    def upto(self, n: int) -> np.ndarray:
        while self.table.shape[1] < n:
            shift = self.table[:, -1:] * self.steps % P
            self.table = np.hstack([self.table, self.table * shift % P])
        return self.table


POWERS = Powers()


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


class PrefixHashes:
    """Prefix arrays of a sequence of code points."""

    def __init__(self, points: np.ndarray, sums: np.ndarray | None = None):
        self.n = len(points)
        done = 0 if sums is None else sums.shape[1] - 1
        terms = (points[done:].astype(np.uint64) + np.uint64(1)) * POWERS.upto(self.n)[:2, done : self.n] % P
        if sums is None:
            sums = np.zeros((2, 1), np.uint64)
        self.points, self.sums = points, np.hstack([sums, (sums[:, -1:] + np.cumsum(terms, axis=1)) % P])

    def edited(self, keep: int, tail: np.ndarray) -> PrefixHashes:
        """The first ``keep`` code points followed by ``tail``; their prefix sums are shared."""
        return PrefixHashes(np.concatenate([self.points[:keep], tail]), self.sums[:, : keep + 1])

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """Hash of a span, independent of where it stands."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        back = POWERS.upto(self.n + 1)[2:, start]
        return tuple(int(x) for x in (self.sums[:, stop] + P - self.sums[:, start]) % P * back % P)

    def common_extension(self, start: int, other: PrefixHashes, other_start: int = 0) -> int:
        """Length of the longest common run from the two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            same = self.span(start, start + mid) == other.span(other_start, other_start + mid)
            low, high = (mid, high) if same else (low, mid - 1)
        return low

    def sketch(self) -> np.ndarray:
        """The ``KEPT`` smallest distinct mixed hashes of all spans of ``SPAN`` code points."""
        if not self.n:
            return np.zeros(0, np.uint32)
        k = min(SPAN, self.n)
        sums, back = self.sums[0], POWERS.upto(self.n)[2]
        spans = (sums[k:] + P - sums[:-k]) % P * back[: self.n - k + 1] % P
        mixed = (spans * _MIX >> np.uint64(32)).astype(np.uint32)
        if len(mixed) > 8 * KEPT:
            least = np.unique(np.partition(mixed, 4 * KEPT)[: 4 * KEPT])
            if len(least) >= KEPT:
                return least[:KEPT]
        return np.unique(mixed)[:KEPT]


class Fingerprint:
    def __init__(self, hashes: PrefixHashes):
        self.n, self.whole, self.least = hashes.n, hashes.span(0, hashes.n), hashes.sketch()

    def __str__(self) -> str:
        return f"{self.n:x}-{self.whole[0]:08x}{self.whole[1]:08x}-{self.least.astype('>u4').tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, least = text.split("-")
        self = cls.__new__(cls)
        self.n, self.whole = int(n, 16), (int(whole[:8], 16), int(whole[8:], 16))
        self.least = np.frombuffer(bytes.fromhex(least), ">u4").astype(np.uint32)
        return self

    def likeness(self, other: Fingerprint) -> float:
        """Share of common spans (Dice), estimated from the smallest hashes of the union.

        1.0 for equal texts, two empty ones included; 0.0 if one is empty.
        Exact up to hash collisions where both texts have at most ``KEPT`` distinct spans.
        """
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        full = len(self.least) == KEPT or len(other.least) == KEPT
        union = np.union1d(self.least, other.least)[: KEPT if full else None]
        both = np.intersect1d(np.intersect1d(self.least, other.least, True), union, True)
        jaccard = len(both) / len(union)
        return 2 * jaccard / (1 + jaccard)


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text; null counts as empty."""
    return str(Fingerprint(PrefixHashes(code_points(text))))


_FIELDS = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double", "common_edited": "long", "common_next": "long",
}


def in_ring_order(rows: DataFrame, id_col: str) -> DataFrame:
    """Range-partition by id (and text hash) and sort, each range ending with its successor.

    Ranges start at rows that occur, so the first row of the next range is also
    sent to the range before it, and the very first to the last: the column
    ``successor`` marks those.  Rows travel once; a range needs no other.
    """
    tie = F.xxhash64("text")
    ranges = ordered_ranges(rows, id_col, tie, shuffle_parts(rows.sparkSession))
    places = F.array(
        F.struct(ranges.own.alias("range"), F.lit(False).alias("successor")),
        F.struct(F.when(ranges.opens, ranges.own - 1).alias("range"), F.lit(True).alias("successor")),
        F.struct(F.when(ranges.first, F.lit(ranges.count - 1)).alias("range"), F.lit(True).alias("successor")),
    )
    dealt = rows.withColumn("place", F.explode(F.filter(places, lambda p: p["range"].isNotNull()))).select(*rows.columns, "place.*")
    return dealt.repartitionById(ranges.count, F.col("range")).sortWithinPartitions("range", "successor", id_col, tie)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document.

    The edited text has its last ``n // 2`` code points replaced by the first
    as many (or all) of the next document in ascending id order; the first
    follows the last.  Columns: those of ``_FIELDS``; ``common_edited`` and
    ``common_next`` are the longest common extensions from the start of the
    text with its edit and with the next text.  Null text counts as empty, null
    ids come first, repeated ids follow each other by a hash of their text, a
    single document is its own successor, an empty table gives no rows.
    """
    rows = clipped(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row's id, text, hashes and fingerprint, whose successor is still to come

        def finish(doc_id, text, hashes, own, after_text, after, after_own) -> tuple:
            half = hashes.n // 2
            edit = hashes.edited(hashes.n - half, after.points[:half])
            changed = Fingerprint(edit)
            digest = hashlib.sha256((text[: hashes.n - half] + after_text[:half]).encode()).hexdigest()
            near = own.likeness(changed), own.likeness(after_own)
            return (doc_id, hashes.n, digest, str(own), str(changed), *near, hashes.common_extension(0, edit), hashes.common_extension(0, after))

        for batch in batches:
            out = []
            for doc_id, text, successor in arrow_rows(batch, "doc_id", "text", "successor"):
                if successor and held is None:
                    continue
                text = text or ""
                after = PrefixHashes(code_points(text))
                after_own = Fingerprint(after)
                if held is not None:
                    out.append(finish(*held, text, after, after_own))
                held = None if successor else (doc_id, text, after, after_own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*out), _FIELDS.values())], names=list(_FIELDS))

    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return in_ring_order(rows, "doc_id").mapInArrow(work, ", ".join(f"{n} {k}" for n, k in _FIELDS.items()))
