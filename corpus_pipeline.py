"""A corpus pipeline of five operators, each stage over what its predecessor kept.

Quality rules, then the ordinal classifier, then one document of each group of
near-duplicates, then redaction of secrets, then packing. Each stage is written
as Parquet in the shared folder and read again.

Rows with null ids, null or empty texts, repeated rows and further columns pass as
the operator of a stage defines it; a stage over an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import near_dedup, ordinal_quality, packing, quality_rules, secrets
from feedloom.llm.common import materialize


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject; edge cases as in ``quality_rules.judge``."""
    return quality_rules.quality_rules_stage(spark, docs, sf_dir)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a clean grade is high enough; edge cases as in ``ordinal_quality.score``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # junk is gone from docs by now: the labelled sample comes from all documents
    model = ordinal_quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return ordinal_quality.select_documents(docs, model)


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near-duplicates; edge cases as in ``near_dedup.one_of_each``."""
    return near_dedup.one_of_each(docs)


def apply_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark; edge cases as in ``secrets.redact``."""
    return secrets.redact(docs)


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two; edge cases as in ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("near-duplicates", apply_near_dedup),
    ("secret scan", apply_secret_scan),
    ("packing", apply_packing),
]

#: Learned models, sketches and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed sequences. Edge cases as in the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
