"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import class_lm, exact_dedup, fingerprints, language_id, licences, merkle, mixing, near_vectors, ngram_join, pieces, token_files, toxicity, whitening
from .common import in_fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), quality=weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("expressions")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = token_files.write_token_shards(table(spark, sf_dir, "documents"), path)
    return token_files.read_documents(shards, columns=("ids_crc32",))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~in_fold(labels["doc_id"], 4, 2)))
    scored = toxicity.score_toxicity(docs, model)
    return scored.withColumn("held_out", in_fold(scored["doc_id"], 4, 2))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = class_lm.train_and_score(docs, ~in_fold(docs["doc_id"], 7, 2))
    return scored.withColumn("held_out", in_fold(scored["doc_id"], 7, 2))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), path, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(docs["doc_id"], 5, 0)
    model = language_id.train(docs.where(~held_out).select("doc_id", "lang", "text"))
    found = language_id.predict_languages(docs, model)
    return found.withColumn("held_out", in_fold(found["doc_id"], 5, 0))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_licences": op4_licences,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_class_lm": op7_class_lm,
    "op8_pieces": op8_pieces,
    "op9_ngram_join": op9_ngram_join,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_near_vectors": op13_near_vectors,
}
