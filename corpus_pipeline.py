"""Corpus pipeline: quality classifier, near-duplicate removal, secret scan, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its rows are written as Parquet
and read back as the next stage's ``docs``. All but the last return the columns of
``documents``. A stage that filters keeps rows whole; the secret scan rewrites ``text``
and its ``n_chars``. Null and empty texts pass the first and third stage; of them, as
of all texts without words, the second keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality, secret_scan, simhash
from tessera.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted texts is too high go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id. ``docs`` are
    files that the stage before wrote: their rows are dropped while they are read again."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_distance=2, in_place=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    masked = secret_scan.mask_secrets(docs)
    n_chars = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", n_chars)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: one row a piece."""
    return packing.pack_documents(docs, capacity=2048, separator=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
