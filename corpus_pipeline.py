"""The corpus pipeline: quality rules, line dedup, near duplicates, shared passages, packing.

Each stage is one operator. It takes all that the stage before it kept, and what it decides takes
effect: documents go, or their text changes. All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridclim.llm.lines import dedup_lines
from gridclim.llm.ngram_join import one_of_each_group
from gridclim.llm.packing import pack_documents
from gridclim.llm.quality import accepted_documents
from gridclim.llm.suffix import dedup_passages
from gridclim.llm.tables import read_table, stored


def with_new_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the new text."""
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", length)
    return changed.select(*[F.col(f"`{name}`") for name in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_new_text(dedup_lines(docs), docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_new_text(dedup_passages(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Compression, merges of a vocabulary and online packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
