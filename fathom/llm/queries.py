"""The registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .licences import scan_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import search

    return search(table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair_store import read_digest, write_ids

    return read_digest(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import digest_texts

    return digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_licence_scans": op3_licence_scans,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_toxicity": op6_toxicity,
    "op7_token_id_output": op7_token_id_output,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op3_licence_scans": scan_sql()}
