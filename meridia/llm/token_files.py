"""Token-id files: fixed-width bit packing with block offsets.

A shard is one self-contained byte string:

    magic "MTK1", id width in bits, ids a block, number of ids, documents and
    blocks (little-endian header), then the documents' ids and their first
    positions, then the byte offset of each block, then the blocks.

A block holds ``block`` ids, each in ``width`` bits from the low bit up, and
starts on a byte, so any position is reached from its block's offset and a
block unpacks as one numpy operation.  Shards are rows of a Parquet table: Spark
writes and commits them on any store and an executor's loss only repeats a task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunk_table import ChunkTable
from .common import arrow_rows, clipped, ordered_ranges, shuffle_parts, staged

MAGIC = b"MTK1"
HEADER = struct.Struct("<4sHIQQQ")
#: Stands for a null document id in a shard.
NULL_ID = -(2**63)


def bits_needed(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each id, low bit first, padded to a whole byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, : width // 8].tobytes()
    bits = np.unpackbits(raw, axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data, n: int, width: int) -> np.ndarray:
    """The ``n`` ids that ``pack_bits`` stored."""
    raw = np.zeros((n, 4), np.uint8)
    if width % 8 == 0:
        k = width // 8
        raw[:, :k] = np.frombuffer(data, np.uint8, n * k).reshape(n, k)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        raw[:, : packed.shape[1]] = packed
    return raw.view("<u4").ravel()


def pack_shard(doc_ids: list[int], ids: list[np.ndarray], width: int, block: int = 4096) -> bytes:
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    if len(flat) and int(flat.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    blocks = [pack_bits(flat[i : i + block], width) for i in range(0, len(flat), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    head = HEADER.pack(MAGIC, width, block, len(flat), len(doc_ids), len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reads a packed shard; ``tokens(a, b)`` touches only the blocks it needs."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.width, self.block, self.n_tokens, n_docs, n_blocks = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.doc_ids = np.frombuffer(self.data, "<i8", n_docs, at)
        self.starts = np.frombuffer(self.data, "<u8", n_docs + 1, at := at + 8 * n_docs)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at := at + 8 * (n_docs + 1))
        self.blocks_at = at + 8 * (n_blocks + 1)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.n_tokens:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_tokens - b * self.block)
            lo, hi = (self.blocks_at + int(self.offsets[b + i]) for i in (0, 1))
            parts.append(unpack_bits(self.data[lo:hi], n, self.width))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


#: A blank after a character that is no white space: a byte-level tokenizer always cuts there.
_CUT = re.compile(r"(?<=\S)(?= )")
#: A blank inside white space, where a cut could split one token.
_INNER_BLANK = re.compile(r"\s \s")


class ByteLevelEncoder:
    """Ids of the tokenizers library, one call per distinct chunk.

    The byte-level pre-tokenizer starts a token at a blank that follows a
    non-space or precedes one, so text splits there into chunks that encode
    independently.  Texts that hold a special token's string go to the library
    whole.
    """

    def __init__(self, path: str, **limits):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = ChunkTable(self._segment, **limits)

    def _segment(self, words: list[str]) -> Iterator[bytes]:
        """Ids of a blank and each word."""
        for e in self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.special):
            return self.whole(text)
        if _INNER_BLANK.search(text):
            first, *rest = _CUT.split(text)
            rest = [chunk[1:] for chunk in rest]
        else:
            first, *rest = text.split(" ")
        head = self.whole(first).tobytes() if first else b""
        return np.frombuffer(head + b"".join(self.table(rest)), "<u4")


@lru_cache(maxsize=2)
def encoder_for(path: str) -> ByteLevelEncoder:
    """One encoder a worker process, so its chunk table serves all the tasks that the process runs."""
    return ByteLevelEncoder(path, limit=800_000)


def write_token_shards(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, shard_tokens: int = 1 << 20
) -> DataFrame:
    """Encode documents in ascending id order into packed shards; returns the written table.

    Columns ``part, shard, first`` (ids of the part before this shard),
    ``n_tokens, n_docs, data``.  Parts are ranges of ids in order.  ``end_id``
    is appended to each document.  Ids must be integers; null ids come first,
    repeated ids follow each other, ordered by a hash of their text.  A null
    text counts as empty.  An empty table gives an empty table.
    """
    rows = clipped(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    tie = F.xxhash64("text")
    ranges = ordered_ranges(rows, "doc_id", tie, shuffle_parts(docs.sparkSession))
    ordered = rows.repartitionById(ranges.count, ranges.own).sortWithinPartitions("doc_id", tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        width = bits_needed(max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1))
        end = np.array([] if end_id is None else [end_id], np.uint32)
        part = TaskContext.get().partitionId()
        names, ids, size, first, shard = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            cells = [[part], [shard], [first], [size], [len(names)], [pack_shard(names, ids, width)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=columns)

        for batch in batches:
            for doc_id, text in arrow_rows(batch, "doc_id", "text"):
                names.append(NULL_ID if doc_id is None else doc_id)
                ids.append(np.concatenate([encoder(text), end]))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield flush()
                    names, ids, size, first, shard = [], [], 0, first + size, shard + 1
        if names:
            yield flush()

    columns = ["part", "shard", "first", "n_tokens", "n_docs", "data"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    shards = ordered.mapInArrow(encode, "part int, shard int, first long, n_tokens long, n_docs long, data binary")
    return staged(shards, "tokens", compression="zstd")


def part_starts(shards: DataFrame) -> DataFrame:
    """``part, before``: ids in all parts before each; a row a part."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def read_documents(shards: DataFrame, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Documents back from shards: ``doc_id, start, n_tokens`` and ``ids`` and/or ``ids_crc32``.

    ``start`` counts the ids of all documents before.  The offsets of the
    parts, one row a part, are all that is broadcast.
    """
    extra = {"ids": "ids array<int>", "ids_crc32": "ids_crc32 long"}
    kinds = {"ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
    placed = shards.join(F.broadcast(part_starts(shards)), "part").select((F.col("before") + F.col("first")).alias("base"), "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = {"ids": lambda x: x.astype(np.int32), "ids_crc32": lambda x: zlib.crc32(x.astype("<u4").tobytes())}
        for batch in batches:
            for base, data in arrow_rows(batch, "base", "data"):
                shard = Shard(data)
                starts = shard.starts.astype(np.int64)
                flat = shard.tokens(0, shard.n_tokens)
                each = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
                names = pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID)
                arrays = [names, pa.array(base + starts[:-1]), pa.array(np.diff(starts))]
                arrays += [pa.array([derive[c](x) for x in each], kinds[c]) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", *columns])

    return placed.mapInArrow(decode, ", ".join(["doc_id long, start long, n_tokens long", *[extra[c] for c in columns]]))
