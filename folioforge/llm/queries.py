"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import dac_codes, decontam, html_paths, language_id, license_index, minhash, packing, pca_join, token_count, toxicity
from folioforge.llm.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(_table(spark, sf_dir, "documents")).drop("places")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, before = dac_codes.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, Workspace(spark, "op4"))
    return dac_codes.read_documents(files, before)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(counted, Workspace(spark, "op6"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op7"), k=4, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_join.similar_vectors(_table(spark, sf_dir, "embeddings"), Workspace(spark, "op9"), threshold=0.9)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Workspace(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_license_scan,
        op3_token_counts,
        op4_token_files,
        op5_language_id,
        op6_best_fit_packing,
        op7_minhash_dedup,
        op8_toxicity,
        op9_embedding_dedup,
        op10_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": license_index.oracle_sql()}
