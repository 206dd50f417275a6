"""Thin registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chaining, fingerprints, jaccard, media, merkle, oracles, packing, pieces, quality, sharding, suffixes, toxicity, yinyang


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_docs(spark, sf_dir), limit=200)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_docs(spark, sf_dir), threshold=0.8, shingle=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op5_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passage_classes(_docs(spark, sf_dir), min_words=50, likeness=0.8)


def op8_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(_docs(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir), shards=16)


def op7_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_docs(spark, sf_dir))


def op10_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_docs(spark, sf_dir))


def op11_yinyang_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = yinyang.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dim=64, scale=64.0)
    return out.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid", "scanned")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, changed={"text": tampered})


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return pieces.encode_documents(_docs(spark, sf_dir), model.read())


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op5_fuzzy_passages": op5_fuzzy_passages,
    "op8_quality_cotraining": op8_quality_cotraining,
    "op4_byte_bpe": op4_byte_bpe,
    "op6_feistel_sharding": op6_feistel_sharding,
    "op7_concat_packing": op7_concat_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_media_sniffing": op10_media_sniffing,
    "op11_yinyang_clustering": op11_yinyang_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLE_SQL: dict[str, str] = {"op11_yinyang_clustering": oracles.clusters(), "op12_merkle_manifest": oracles.manifest()}
