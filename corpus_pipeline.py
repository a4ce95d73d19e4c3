"""From raw documents to packed training sequences, one operator after the other.

Each stage gets the documents that its predecessor kept, in the columns of `documents`, and
its result is stored as Parquet and read again; the last stage gives the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossledger.llm import near_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from lossledger.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the n-gram verdict, learned from all of `documents`."""
    return quality_rules.keep_passing(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one_of_each(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long byte strings that repeat."""
    return suffix_dedup.strip_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("near dedup", near_dedup_stage),
    ("suffix dedup", suffix_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: The classifiers are not expressible in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
