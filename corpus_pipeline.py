"""A corpus pipeline of five of the operators: each stage takes the documents that the one before it kept.

A stage is a function of (spark, docs, sf_dir); run() writes each stage's result as Parquet to the shared folder and
reads it again.  All stages but the last return the columns of documents.  A stage keeps the columns it does not
change; n_chars follows the text.  Nulls: a null text is an empty one after the third stage, and a null doc_id is kept
by every stage (see the operators).  Rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.features import remainder
from basalt.llm.op02_decontamination import decontaminate
from basalt.llm.op04_minhash_dedup import near_duplicates
from basalt.llm.op06_best_fit_packing import best_fit_packing
from basalt.llm.op07_quality_classifier import classify
from basalt.llm.op08_substring_dedup import substring_dedup
from basalt.llm.shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more."""
    docs = docs.select(*COLUMNS)
    scored = classify(docs, table(spark, sf_dir, "labels"), "quality", remainder(4) != 2, learn_from=table(spark, sf_dir, "documents"))
    return scored.where("score >= 0.7").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: 0.8 of five-word shingles; the smallest doc_id stays.

    A row goes by its doc_id and its text together, so that an unlike text under the same doc_id stays.  Of rows that
    share the smallest doc_id and a group, all stay.
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).distinct()
    return docs.join(gone, F.expr("doc_id = g_id AND xxhash64(text) = g_key"), "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches that earlier ones hold; those of which no word is left go.  A text without such stretches stays as it is."""
    out = substring_dedup(docs, keep=("lang", "source", "n_chars"), untouched=True)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    docs = docs.select(*COLUMNS)
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key")).distinct()
    return docs.join(bad, F.expr("doc_id <=> b_id AND xxhash64(text) = b_key"), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed into sequences of 2048 tokens."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", uncontaminated),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Classifier and packing cannot be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
