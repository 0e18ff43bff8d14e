"""The corpus pipeline: quality, language, near copies, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftstone.llm import language_id, mixing, ngram_join, packing, quality_model
from siftstone.llm.durable import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.kept(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, power=mixing.POWER, share=mixing.SHARE)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.bins(docs)


#: Each stage takes the documents that the one before it left; the last gives the bins.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("op7 quality", quality),
    ("op2 language", language),
    ("op1 deduplication", deduplication),
    ("op5 mixture", mixture),
    ("op8 bins", bins),
]

#: No SQL says the same.
ORACLE_SQL = ""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
