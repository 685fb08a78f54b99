"""The corpus pipeline: five stages, each on all that its predecessor kept.

Defined results: null and empty texts fail the quality rules and go; other
columns may be null and pass through, extra ones and clashing names too; of
rows that repeat doc_id and text a defined one stays (the exact dedup); rows
without a doc_id are judged and deduplicated by their text, link nothing in the
near dedup and are packed; very long texts count whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netweave.llm import exact_dedup, ngram_join, packing, quality_model, quality_rules
from netweave.llm.common import Scratch


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule go."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go; it learns from the labelled part of all documents."""
    model = quality_model.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the least doc_id of each component stays."""
    return ngram_join.drop_near_copies(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stayed, as pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_rule_stage),
    ("quality classifier", quality_classifier_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram jaccard join", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
