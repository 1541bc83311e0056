"""Corpus pipeline: documents to packed training sequences.

Each stage takes what the one before kept, as Parquet, and its decisions take effect: documents
of unknown language go, documents that the quality rules reject go, one document of
each near-duplicate group stays, the sources are mixed to their target weights by whole documents,
and the result is packed into sequences. ``run`` returns the rows of the last stage: one per
piece. Null, empty, repeated rows and empty tables are handled as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrilake.llm import jaccard, language, mixing, packing, quality
from sentrilake.llm.scratch import Scratch
from sentrilake.session import cut


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language that holds a third of the words, go. The model is
    learned from a bounded sample of the labelled rows."""
    return language.keep_language(docs, language.train(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes out as often as the mix takes it: up to three times, or not at all."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The language model and the tokenizer cannot be expressed in SQL; tests/llm compares plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage kept is deleted once the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            earlier, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
            scratch.drop(earlier)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
