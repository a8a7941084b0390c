"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  The first four
return the columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isohyet.llm import op2_jaccard, op5_decontamination, op6_packing, op8_quality, op9_bayes
from isohyet.llm.common import materialise
from isohyet.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or lie far from their language go."""
    return op8_quality.kept_rows(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for poor ones go.

    It learns from all labelled ``documents``: the rules have already taken most poor ones from ``docs``.
    """
    read = spark.read.parquet
    return op9_bayes.kept_rows(docs, read(f"{sf_dir}/labels.parquet"), read(f"{sf_dir}/documents.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, one of each group stays."""
    return op2_jaccard.first_of_each(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return op5_decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed."""
    return op6_packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer are beyond SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
