"""Queries over the driver tables that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, gif, jaccard, langid, license, lines, lm, packing, shards
from .common import table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(table(spark, sf_dir, "documents"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.digest(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.ORACLE, "op4_extendible_shards": shards.ORACLE, "op5_embedding_neardup": embeddings.ORACLE, "op7_license_scan": license.ORACLE, "op9_ngram_jaccard": jaccard.ORACLE}
