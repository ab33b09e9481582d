"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next.

The driver deletes this file together with the llm folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import packing, quality_model, quality_rules, simhash, span_dedup
from sievelake.llm.shared import drop_table, materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from the labels of those still here."""
    return quality_model.keep_predicted(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id."""
    return simhash.first_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of passages that an earlier document or place has."""
    return span_dedup.dedup_spans(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all documents are packed into."""
    return packing.packed_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packed),
]

#: The stages learn, hash and tokenize outside SQL, so there is none; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            drop_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
