"""From raw documents to token ids: the stages of one training-corpus run.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  Empty tables pass through as empty
ones, and columns beyond the usual ones stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meridia.llm import exact_dedup, language_id, mixing, ngram_join, pieces
from meridia.llm.common import staged


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty ones too) and those no language's model accepts; repeated rows alike."""
    model = language_id.train(docs.select("doc_id", "lang", "text"))
    return language_id.keep_identified(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, a null id only where there is no other; of repeated rows one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of Jaccard 0.75 over five-word shingles join, the smallest id stays; texts without a word link with nothing."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources meet their target weights; a null source is one of its own."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_documents(docs, quality=mixing.quality_weights(labels))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the text they decode to; a null text has no id."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_pieces(docs, path, columns=("n_tokens", "ids", "decoded_sha256"), table_limit=60_000)


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: Several stages have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else staged(out, "stage")
    return docs
