"""The registered queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import byte_bpe, decontaminate, language, licences, neighbours, packing, pii, pii_sql, sharding, shingle_join, spelling, token_counts, token_files, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_docs(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(_docs(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find(_docs(spark, sf_dir))


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.with_spans(_docs(spark, sf_dir)))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link(_docs(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(importable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_licence_scan": op6_licence_scan,
    "op7_extendible_sharding": op7_extendible_sharding,
    "op8_personal_data": op8_personal_data,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_shingle_join": op10_shingle_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op7_extendible_sharding": sharding.sql(),
    "op8_personal_data": pii_sql.sql(),
}
