"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of hashed word shingles; equal sets are one class.

1. *Postings.*  Every class sends its shingles, packed in blocks, to their hash
   bucket once.  A bucket keeps only shingles of two classes or more and sends
   those on, with their frequency, to their class.
2. *Survivors.*  A class of ``n`` shingles can only link when at least
   ``T = ceil(0.75 n)`` of them are shared.  Of what survives, the shared
   shingles among the ``n - T + 1`` rarest form the short lists: every linked
   pair meets in one of them, however long the other lists are.
3. *Search.*  Lists name the buckets of index classes a query has to search; a
   bucket is held in one task as an inverted index and its queries stream past
   it.  Each query heap-merges its short lists, sets aside the longest ``L`` and
   probes those by binary search (DivideSkip), and keeps what reaches the overlap.
4. *Components.*  First each list sends its members to one hub only, so a large
   group of near copies joins its hub in as many links as it has members.  Then
   members of lists that still span components search all the buckets that hold
   another such member.  Lists inside one component need no search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, clipped, discard, free_names, lower_az, shuffle_parts, small_side, staged
from .components import connected_components

WIDTH = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: Between tasks a shingle is its bucket and this many bits of its hash; as
#: buckets grow in number with the data, chance equality stays under one in 100 million.
BITS = 48
#: Shingles a task gathers before it sends blocks, and that a bucket holds on average.
FLUSH = 600_000
PER_BUCKET = 1_500_000
#: Index classes and their shingles that a search bucket holds on average.
PER_INDEX, INDEX_SHINGLES = 500, 500_000
#: Sizes and counts travel in two bytes; larger sizes saturate, larger counts are split.
_MOST = 65_535
#: DivideSkip's cost ratio of probing a long list to merging it.
MU = 0.0085

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) for k in range(WIDTH)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, cut at ASCII white space."""
    raw = np.frombuffer(lower_az(text), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    word = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A byte counts with its place in its word through a mixing function, so no structure of a word carries over to its sum.
    letters = raw[word]
    lengths = stops - starts
    places = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.add.reduceat(mixed((places.astype(np.uint64) << np.uint64(8) | letters) + np.uint64(_BASE)), np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all five-word shingles; of fewer words, the whole sequence as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < WIDTH:
        total = (words * _PLACES[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mixed(np.array([total], np.uint64))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += words[k : k + n] * _PLACES[k]
    return np.unique(mixed(total))


def set_digest(shingles: np.ndarray) -> int:
    """One signed 64-bit value for a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    total = mixed(shingles * np.uint64(_BASE)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0]) or 1


def least_overlap(n: np.ndarray | int):
    """Shingles a set of ``n`` shares with any set it links to, at least."""
    return -(-PERCENT * n // 100)


def linked(both: int, n: int, m: int) -> bool:
    return 100 * both >= PERCENT * (n + m - both)


def document_sets(docs: DataFrame) -> DataFrame:
    """``n_shingles, digest`` of every row, after its columns other than ``text``."""
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), set_digest(s)) for (text,) in arrow_rows(batch, "text") for s in [shingle_set(text)]]
            if found:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(c, pa.int64()) for c in zip(*found)]], names=schema.names)

    return docs.mapInArrow(work, schema)


_BLOCK = "bucket int, members binary, sizes binary, counts binary, hashes binary, extra binary"
_BLOCK_NAMES = ["bucket", "members", "sizes", "counts", "hashes", "extra"]
_BLOCK_TYPES = [pa.int32(), *[pa.binary()] * 5]


def pack_blocks(bucket: np.ndarray, member: np.ndarray, size: np.ndarray, hashes: np.ndarray, extra: np.ndarray | None = None, width: int = BITS // 8) -> pa.RecordBatch:
    """Rows (class, its size, hash in ``width`` bytes, extra), grouped into one block a bucket, each class named once a block."""
    order = np.lexsort((hashes, member, bucket))
    bucket, member, size, hashes = bucket[order], member[order], size[order], hashes[order]
    extra = None if extra is None else extra[order]
    opens = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (member[1:] != member[:-1])])[: len(bucket)])
    counts = np.diff(np.append(opens, len(bucket)))
    if len(counts) and counts.max() > _MOST:
        opens = np.sort(np.concatenate([np.arange(i, i + n, _MOST) for i, n in zip(opens, counts)]))
        counts = np.diff(np.append(opens, len(bucket)))
    counts, size = counts.astype("<u2"), np.minimum(size, _MOST).astype("<u2")
    packed = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    names, first = np.unique(bucket[opens], return_index=True)
    ends = np.append(first[1:], len(opens))
    rows = []
    for b, i, j in zip(names.tolist(), first.tolist(), ends.tolist()):
        lo, hi = opens[i], opens[j - 1] + int(counts[j - 1])
        more = b"" if extra is None else extra[lo:hi].astype("<u4").tobytes()
        rows.append((b, member[opens[i:j]].astype("<i8").tobytes(), size[opens[i:j]].tobytes(), counts[i:j].tobytes(), packed[lo:hi].tobytes(), more))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK_TYPES)] if rows else [pa.array([], t) for t in _BLOCK_TYPES], names=_BLOCK_NAMES)


def unpack_blocks(blocks: list[tuple], width: int = BITS // 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, size, hash and extra of each row of a bucket's blocks."""
    members, sizes, counts, hashes, extra = (np.concatenate([np.frombuffer(b[i], t) for b in blocks]) for i, t in enumerate(("<i8", "<u2", "<u2", "u1", "<u4")))
    full = np.zeros((len(hashes) // width, 8), np.uint8)
    full[:, :width] = hashes.reshape(-1, width)
    return np.repeat(members, counts), np.repeat(sizes, counts), full.view("<u8").ravel(), extra


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Blocks of one bucket after another from batches sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for bucket, *block in arrow_rows(batch, *_BLOCK_NAMES):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(tuple(block))
    if held:
        yield now, held


def shingle_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Shingles of every class a task meets, once a task, in blocks by hash bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        waiting = 0

        def blocks() -> pa.RecordBatch:
            lengths = [len(s) for _, s in held]
            hashes = np.concatenate([s for _, s in held])
            member = np.repeat(np.array([d for d, _ in held], np.int64), lengths)
            return pack_blocks((hashes % np.uint64(buckets)).astype(np.int32), member, np.repeat(lengths, lengths), hashes >> np.uint64(64 - BITS))

        for batch in batches:
            for (text,) in arrow_rows(batch, "text"):
                shingles = shingle_set(text)
                digest = set_digest(shingles)
                if digest and digest not in seen:
                    seen.add(digest)
                    held.append((digest, shingles))
                    waiting += len(shingles)
                    if waiting >= FLUSH:
                        yield blocks()
                        held, waiting = [], 0
        if held:
            yield blocks()

    return docs.select("text").mapInArrow(work, _BLOCK)


def shared_shingles(blocks: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Shingles of two classes or more, with their frequency, in blocks by class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(batches):
            member, size, hashes, _ = unpack_blocks(held)
            hashes = mixed(hashes + np.uint64(bucket * _BASE & (2**64 - 1)))
            order = np.lexsort((member, hashes))
            member, size, hashes = member[order], size[order], hashes[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (member[1:] != member[:-1])])
            member, size, hashes = member[new], size[new], hashes[new]
            opens = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            lengths = np.diff(np.append(opens, len(hashes)))
            frequency = np.repeat(lengths, lengths)
            keep = frequency > 1
            if keep.any():
                target = (mixed(member[keep].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield pack_blocks(target, member[keep], size[keep], hashes[keep], frequency[keep], width=8)

    return blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(work, _BLOCK)


def survivors(shared: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """``digest, n, shingles, short``: classes that can link, their shared shingles (sorted, packed) and short lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            member, size, hashes, frequency = unpack_blocks(held, width=8)
            order = np.lexsort((hashes, member))
            member, size, hashes, frequency = member[order], size[order], hashes[order], frequency[order]
            opens = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
            lengths = np.diff(np.append(opens, len(member)))
            need = least_overlap(size[opens].astype(np.int64))
            rows = []
            for i in np.flatnonzero(lengths >= need).tolist():
                span = slice(opens[i], opens[i] + lengths[i])
                rarest = np.lexsort((hashes[span], frequency[span]))[: lengths[i] - need[i] + 1]
                rows.append((int(member[opens[i]]), hashes[span].astype("<u8").tobytes(), hashes[span][rarest].astype(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["digest", "shingles", "short"])

    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
    able = shared.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(work, "digest long, shingles binary, short array<long>")
    sizes = sets.where("n_shingles > 0").groupBy("digest").agg(F.first("n_shingles").cast("int").alias("n"))
    return able.join(sizes, "digest")


class InvertedIndex:
    """Inverted lists over a few index sets, searched with DivideSkip.

    Shingles with the same list (runs of text that the same sets share) keep it
    once; a query counts such a list with the number of its shingles there.
    """

    def __init__(self, sets: list[tuple[int, int, np.ndarray]]):
        self.names, self.sizes = [s[0] for s in sets], [s[1] for s in sets]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(s[2] for s in sets)])
        places = np.repeat(np.arange(len(sets)), [len(s[2]) for s in sets])
        order = np.argsort(hashes, kind="stable")
        places = places[order]
        self.keys, opens = np.unique(hashes[order], return_index=True)
        lengths = np.diff(np.append(opens, len(order)))
        signs = np.add.reduceat(mixed(places.astype(np.uint64) + np.uint64(1)), opens) if len(opens) else hashes
        _, first, self.list_of = np.unique(signs, return_index=True, return_inverse=True)
        self.lengths = lengths[first]
        self.starts = np.append(0, np.cumsum(self.lengths))
        inner = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1], self.lengths)
        self.places = places[np.repeat(opens[first], self.lengths) + inner]
        #: List and place in one number, in ascending order: a probe of any list is one binary search.
        self.codes = np.repeat(np.arange(len(first)), self.lengths) * len(sets) + self.places

    def search(self, hashes: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Places and overlaps of the sets that link to a set of ``n`` shingles, given those it may share."""
        need = least_overlap(n)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at = at[self.keys[at] == hashes]
        if len(at) < need:
            return
        lists, weight = np.unique(self.list_of[at], return_counts=True)
        order = np.argsort(self.lengths[lists], kind="stable")
        lists, weight = lists[order], weight[order]
        most = min(need - 1, int(need / (MU * max(1.0, np.log2(self.lengths[lists[-1]] + 1)) + 1)))
        cut = int((np.cumsum(weight[::-1])[::-1] > most).sum())
        aside = int(weight[cut:].sum())
        short = [[(p, w) for p in self.places[self.starts[i] : self.starts[i + 1]].tolist()] for i, w in zip(lists[:cut].tolist(), weight[:cut].tolist())]
        long, long_weight = lists[cut:] * len(self.sizes), weight[cut:]
        counts: dict[int, int] = {}
        for place, w in heapq.merge(*short):
            counts[place] = counts.get(place, 0) + w
        for place, both in counts.items():
            m = self.sizes[place]
            if both < need - aside or 100 * min(n, m) < PERCENT * max(n, m):
                continue
            spots = np.minimum(np.searchsorted(self.codes, long + place), len(self.codes) - 1)
            both += int(long_weight[self.codes[spots] == long + place].sum())
            if linked(both, n, m):
                yield place, both


class Groups:
    """Union-find over the places of one task's index."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x


def find_links(queries: DataFrame, index: DataFrame, sets: DataFrame, parts: int, per_task: int = 1_000) -> DataFrame:
    """``a, b``: links that join all that links between queries and index classes of one bucket join.

    Both tables are ``digest, bucket``.  A bucket that more than ``per_task``
    queries need is copied to as many tasks as it takes.  A task names one link
    from a query to each group of index classes that its earlier links haven't
    joined yet, so it returns at most one row more for every query and every
    index class, however many links there are.
    """
    queries = staged(queries.distinct(), "queries")
    copies = queries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("copies"))
    copies = staged(copies, "copies")
    slot = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("copies")).cast("int").alias("slot")
    asked = queries.join(copies, "bucket").select("digest", "bucket", slot, F.lit(1).alias("asks"))
    index = index.distinct().join(copies, "bucket")
    index = index.select("digest", "bucket", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("slot"), F.lit(0).alias("asks"))
    rows = asked.unionByName(index).join(sets.select("digest", "n", "shingles"), "digest")
    rows = rows.repartition(parts, "bucket", "slot").sortWithinPartitions("bucket", "slot", "asks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, groups = None, [], None, None
        for batch in batches:
            out = []
            for bucket, slot, asks, digest, n, packed in arrow_rows(batch, "bucket", "slot", "asks", "digest", "n", "shingles"):
                if (bucket, slot) != now:
                    now, held, index = (bucket, slot), [], None
                hashes = np.frombuffer(packed, "<u8")
                if not asks:
                    held.append((digest, n, hashes))
                    continue
                if index is None:
                    index = InvertedIndex(sorted(held, key=lambda s: s[0]))
                    groups = Groups(len(held))
                roots = {}
                for place, _ in index.search(hashes, n):
                    if index.names[place] != digest:
                        roots.setdefault(groups.root(place), place)
                out += [(digest, index.names[place]) for place in roots.values()]
                first = min(roots, default=0)
                for r in roots:
                    groups.parent[r] = first
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    links = staged(rows.mapInArrow(work, "a long, b long"), "links")
    discard(queries)
    discard(copies)
    return links


def similar_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def index_buckets(members: Column, shingles: Column) -> Column:
    """How many buckets some index classes take, given their number and that of their shingles."""
    return F.ceil(F.greatest(members / PER_INDEX, shingles / INDEX_SHINGLES, F.lit(1.0)))


def class_components(sets: DataFrame, parts: int) -> DataFrame:
    """``digest, component`` for every class that links to another.

    Index classes are dealt into buckets of bounded size; it is buckets that
    queries are sent to, so no list is ever written out as pairs.
    """
    shared = F.length("shingles") / 8 / F.col("n")
    lists = staged(sets.select("digest", "n", shared.alias("shared"), F.explode("short").alias("shingle")), "lists")

    # The hub of a list is the member that shares most of its shingles: of near copies the text they were made from.
    hubs = lists.groupBy("shingle").agg(F.max(F.struct("shared", "digest", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    met = lists.join(hubs, "shingle").where((F.col("digest") != F.col("hub.digest")) & similar_size(F.col("n"), F.col("hub.n")))
    pairs = staged(met.select("digest", F.col("hub.digest").alias("hub"), F.col("hub.n").alias("m")).distinct(), "pairs")
    indexed = pairs.select("hub", "m").distinct()
    buckets = indexed.agg(index_buckets(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).alias("n")).first()["n"]
    bucket = F.pmod(F.xxhash64("hub"), F.lit(buckets)).cast("long").alias("bucket")
    links = find_links(pairs.select("digest", bucket), pairs.select(F.col("hub").alias("digest"), bucket), sets, parts)
    discard(pairs)
    found = connected_components(links)

    # What a hub didn't join: members of one list in different components.
    placed = lists.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("label", "digest")).drop("label")
    span = placed.groupBy("shingle").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"))
    open_ = staged(placed.join(span.where("c <> d").select("shingle", "members", index_buckets(F.col("members"), F.col("size")).alias("cuts")), "shingle"), "open")
    # A class is indexed with its longest list, which is cut by digest; what shares lists thus shares buckets.
    home = open_.groupBy("digest").agg(F.max(F.struct("members", "shingle", "cuts")).alias("home"))
    cut = F.floor((F.col("digest") / F.lit(2.0**64) + 0.5) * F.col("home.cuts"))
    index = staged(home.select("digest", F.xxhash64("home.shingle", cut).alias("bucket")), "index")
    reach = open_.join(index, "digest").groupBy("shingle", "bucket").agg(
        F.max("digest").alias("last"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("c"), F.max("component").alias("d"))
    new = (F.col("c") != F.col("component")) | (F.col("d") != F.col("component"))
    fits = (100 * F.col("n") >= PERCENT * F.col("least")) & (PERCENT * F.col("n") <= 100 * F.col("most"))
    queries = open_.join(reach, "shingle").where((F.col("digest") < F.col("last")) & new & fits).select("digest", "bucket")
    more = find_links(queries, index, sets, parts)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    for done in (lists, links, open_, index, more):
        discard(done)
    return found.select(F.col("node").alias("digest"), F.col("label").alias("component"))


def sets_and_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document sets of ``rows``, and ``digest, component`` of every class that links to another."""
    parts = shuffle_parts(rows.sparkSession)
    sets = staged(document_sets(rows), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(min(parts, 24), -(-total // PER_BUCKET))
    shared = shared_shingles(shingle_blocks(rows, buckets), buckets, parts)
    able = staged(survivors(shared, sets, parts), "survivors", compression="zstd")
    classes = class_components(able, parts)
    discard(able)
    return sets, classes


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest id among the documents that links reach,
    the document's own included.  A text without a word, or null, has no
    shingle and links with nothing.  Rows that repeat a text are in one
    component; null ids take part but name a component only where it has no
    other id.  An empty table gives an empty result.
    """
    sets, classes = sets_and_classes(clipped(docs, doc_id=id_col, text=text_col))
    full = sets.where("n_shingles > 0")
    least = full.groupBy("digest").agg(F.min("doc_id").alias("least"))
    least = least.join(classes, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.select("digest", "component").join(named, "component").select("digest", "component_id")
    found = full.join(named, "digest").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that stay: of each component one, by smallest id (nulls last), digest and text hash.

    Rows are told apart by a number of their own, as ids may be null or repeat.
    Texts without a word, or null, link with nothing and stay; an empty table
    gives an empty result.
    """
    (number,) = free_names(docs, "row_number")
    numbered = staged(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    rows = clipped(numbered, doc_id=id_col, row=number, text=text_col).withColumn("sign", F.xxhash64("text"))
    sets, classes = sets_and_classes(rows)
    full = sets.where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "sign", "row")
    best = full.groupBy("digest").agg(F.min(rank).alias("best")).join(classes, "digest", "left")
    best = best.groupBy(F.coalesce("component", "digest").alias("component")).agg(F.min("best").alias("best"))
    gone = staged(full.select("row").join(best.select(F.col("best.row").alias("row")), "row", "left_anti").withColumnRenamed("row", number), "gone")
    return numbered.join(small_side(gone), number, "left_anti").select(*[numbered[c] for c in docs.columns])
