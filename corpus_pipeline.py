"""Corpus pipeline: language identification, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard, langid, lines, packing
from tessella.llm.common import stored, table

#: Words in a shingle and similarity in hundredths from which documents count as near copies.
SHINGLE, PERCENT = 5, 80


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; null, empty and letterless texts go.

    Where no document has a language to learn from, nothing else is rejected.
    """
    model = langid.fit(docs.where(langid.trained_on()))
    return langid.predict(docs, model).where(~F.col("lang_rejected")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of windows that stand earlier; those of which nothing is left go. n_chars follows the text."""
    left = lines.dedup_lines(docs)
    kept = left.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select([n.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that similarity links, directly or through others, the one of the smallest id, null ids last.

    Rows are known by their id with a hash of their text, so different texts of one id, or of none, are decided apart;
    rows that agree in both are one, of which any stays.
    """
    known = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_hash"))
    groups = jaccard.join(docs.select(known.alias("_row"), "text"), SHINGLE, PERCENT, "_row")
    kept = stored(groups.where("_row = component_id").select(F.col("_row.doc_id").alias("_id"), F.col("_row.text_hash").alias("_hash")).distinct())
    rows = docs.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"])
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (F.col("_text_hash") == F.col("_hash")), "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin, its place in it and the bin's length."""
    return packing.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

#: A language model and a packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
