"""A corpus pipeline: toxicity, quality classifier, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns the packed pieces. Between stages the documents are written as Parquet to the
shared folder and read again, so that a lost executor costs one stage's tasks at most.

Defined results, of every stage: rows are judged one by one by their own texts, so repeated rows, equal doc_ids
and null doc_ids need no care (near-dedup leaves one of repeated rows); null and empty texts are not toxic,
have no copies and no benchmark windows, are judged by their page alone in the quality stage, and are packed as their end
token; other columns, whatever their names, stay as they are until packing; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookwave.llm.decontamination import without_items
from brookwave.llm.near_duplicates import one_of_each
from brookwave.llm.packing import default_tokenizer, pack
from brookwave.llm.quality_classifier import of_quality
from brookwave.llm.shared import read, small_batches, stored
from brookwave.llm.toxicity import nontoxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below its threshold."""
    return nontoxic(docs, read(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together take for quality."""
    return of_quality(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, row by row: the first in the order of files and of rows in them."""
    small_batches(spark)
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return without_items(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences."""
    small_batches(spark)
    return pack(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs


#: Merges, trained models and components are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None
