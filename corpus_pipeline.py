"""A training corpus from ``documents``: quality classifier, n-gram Jaccard join, substring dedup, decontamination, packing.

Every stage is a function of (spark, docs, folder) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import crf, decontaminate, ngram_join, packing, substring_dedup
from cohortlens.llm.catalog import table
from cohortlens.session import materialise


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return crf.keep_good(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngram_join.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages that stand in an earlier document too are cut out; the documents stay."""
    return substring_dedup.remove_repeats(docs)


def benchmark_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What is left becomes sequences, every window in the proportions of the sources."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality), ("ngram_join", near_duplicates), ("substring_dedup", repeats),
    ("decontamination", benchmark_copies), ("packing", pack)]

#: Classifier, alignment and tokeniser cannot be said in SQL; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, folder), name)
    return docs
