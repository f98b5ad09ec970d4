"""A training corpus from `documents`: filter, deduplicate, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelens.llm.jaccard import JaccardRules, near_dedup_stage
from treelens.llm.lines import line_dedup_stage
from treelens.llm.mixing import MixRules, mixing_stage, read_labels
from treelens.llm.packing import pack
from treelens.llm.quality import quality_stage
from treelens.operators.workspace import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    return quality_stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return line_dedup_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 and more of their runs of five words are common."""
    return near_dedup_stage(docs, JaccardRules(n=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, fitted to the targets of the domains."""
    return mixing_stage(docs, read_labels(spark, sf_dir), MixRules())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

# The stages are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
