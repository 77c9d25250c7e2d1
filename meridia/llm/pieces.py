"""SentencePiece encoding and decoding through a distinct-chunk table.

The vocabulary is checked: no piece may hold a white-space marker after
another character.  Then no merge crosses the start of a run of markers, so a
text falls into chunks (a run of markers and the word after it) that are
segmented independently.  Each distinct chunk is segmented and decoded once
per task with the sentencepiece library, and ids and text are joined back by
position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunk_table import ChunkTable
from .common import arrow_rows, clipped

#: The library's white-space marker.
MARK = "▁"
#: Characters of text whose results a task holds before it hands them on.
FLUSH = 2_000_000

COLUMNS = {
    "ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


class PieceCodec:
    """Encodes and decodes whole texts, chunk by distinct chunk."""

    def __init__(self, model_path: str, **limits):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.decode(self.model.encode("a")) == "a"
        self.mark_id = self.model.piece_to_id(MARK)
        self.table = ChunkTable(self._segment, **limits)

    def _segment(self, chunks: list[str]) -> Iterator[tuple[str, str]]:
        """Ids (decimal, comma-joined) and decoded text of each chunk, its first marker included.

        The library itself puts one marker before what it encodes and takes
        one off when it decodes, so a chunk goes in without its first.
        """
        for chunk in chunks:
            ids = self.model.encode(chunk[1:]) if len(chunk) > 1 else [self.mark_id]
            yield ",".join(map(str, ids)), " " + self.model.decode(ids)

    def __call__(self, text: str | None) -> tuple[str, str]:
        """Ids as decimals joined by commas, and the text they decode to."""
        if not text:
            return "", ""
        if not self.separable:
            ids = self.model.encode(text)
            return ",".join(map(str, ids)), self.model.decode(ids)
        plain = " " + text.replace(MARK, " ")
        chunks = re.findall(" +[^ ]*", plain)
        ids, decoded = zip(*self.table(chunks))
        return ",".join(ids), "".join(decoded)[1:]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("ids", "decoded"), table_limit: int = 300_000) -> DataFrame:
    """``doc_id`` and the asked-for columns of each document, whole text, no shuffle.

    ``ids`` are those of the library without begin or end ids, ``decoded`` is
    what its ``decode(ids)`` gives; ``n_tokens`` and the SHA-256 digests (of
    the decimal ids joined by commas, of the decoded text in UTF-8) derive from
    them.  A null text counts as empty and has no ids.  Repeated rows give
    repeated results; an empty table gives an empty result.  A task remembers
    ``table_limit`` distinct chunks; it bounds memory, results don't hang on it.
    """
    if unknown := set(columns) - set(COLUMNS):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    rows = clipped(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, COLUMNS[c]) for c in columns]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path, limit=table_limit)
        derive = {
            "ids": lambda ids, _: np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32),
            "n_tokens": lambda ids, _: ids.count(",") + 1 if ids else 0,
            "ids_sha256": lambda ids, _: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded": lambda _, decoded: decoded,
            "decoded_sha256": lambda _, decoded: hashlib.sha256(decoded.encode()).hexdigest(),
        }

        def column(name: str, values: list) -> pa.Array:
            if name == "ids":
                offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            return pa.array(values, pa.int64() if name == "n_tokens" else pa.string())

        for batch in batches:
            out, start, waiting = {c: [] for c in columns}, 0, 0
            for i, (text,) in enumerate(arrow_rows(batch, "text"), 1):
                found = codec(text)
                for c in columns:
                    out[c].append(derive[c](*found))
                waiting += len(text or "")
                if waiting >= FLUSH or i == batch.num_rows:
                    arrays = [batch.column(0).slice(start, i - start), *[column(c, out[c]) for c in columns]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])
                    out, start, waiting = {c: [] for c in columns}, i, 0

    return rows.mapInArrow(encode, schema)
