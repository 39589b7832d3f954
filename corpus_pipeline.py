"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality rules, quality classifier, line dedup, near-duplicate join, best-fit packing.
Stages bound the session's batches, read and for Python, and its row groups (:func:`bound_batches`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import jaccard, line_dedup, packing, quality_classifier, quality_rules
from trafficlens.llm.common import bound_batches, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's fences."""
    bound_batches(spark)
    return quality_rules.filter_rules(docs.select(*COLUMNS))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the model is learnt from all labelled documents, those that the rules rejected too."""
    bound_batches(spark)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = materialize(quality_classifier.vectors(whole, "doc_id", "text"), "statistics")
    return quality_classifier.filter_quality(docs.select(*COLUMNS), quality_classifier.train(labelled, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; a text that loses a line gets its new length."""
    bound_batches(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    bound_batches(spark)
    return jaccard.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document lies."""
    bound_batches(spark)
    return packing.pack(packing.with_lengths(docs.select("doc_id", "text", "source")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("line_dedup", lines),
    ("jaccard_join", near),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor best fit; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
