"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import Scratch
from millrace.llm.jaccard import keep_one
from millrace.llm.langid import keep_identified
from millrace.llm.packing import best_fit_pack
from millrace.llm.queries import VOCABULARY
from millrace.llm.substring import keep_new


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles."""
    return keep_one(docs, k=5, part=80, whole=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document keeps."""
    return keep_new(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    return best_fit_pack(docs, VOCABULARY, most=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: No SQL can express the first and the last stage; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = scratch.settle(partial(stage, spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
