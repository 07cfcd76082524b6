"""A training-corpus pipeline over ``documents``: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet in
the shared folder and read again as the next one's docs. All stages but the last return the columns of ``documents``.

Defined cases, for every stage: a null text counts as empty (and stays null where it is kept); very long texts count
whole; repeated rows are judged alike, and near-duplicates keeps one of them; rows with a null id are judged like others,
but never dropped as copies; an empty table gives an empty one; further columns, of whatever names, are kept by all stages
but the last. Ties are settled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import blob_ledger, knn_quality, near_copies, slack_packing, toxicity
from curatrix.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.5, so an even vote stays). Empty texts take the
    sample's share of good labels as their score."""
    return knn_quality.accepted(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't mark (score below 0.5, so an even one goes)."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a placeholder and n_chars brought up to date where there were any."""
    return blob_ledger.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows of 2048 ids."""
    return slack_packing.pack(docs)


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("near-dedup", near_duplicates), ("secret scans", secrets), ("packing", packing)]

#: Learned classifiers, XXH64 fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
