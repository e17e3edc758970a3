"""A training corpus from raw documents, in stages that are each written and read again.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any
name; all but the last return the columns of docs.  Rows without an id are never near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, decontaminate, neardup, pii, toxicity
from quantloom.llm.shared import discard, small_batches, stored, table

#: Documents that score as much or more are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier doesn't call toxic; it learns from the labels of documents in docs.

    Null and empty texts score as texts without words; without labels of both kinds nothing is rejected.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more on five-word shingles join: the one with the smallest id, all
    its rows. Null and empty texts, and rows without an id, stay."""
    small_batches(spark)
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of the benchmark; null and empty texts stay, an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced in their texts; n_chars follows. Null texts stay as they are."""
    small_batches(spark)
    return pii.mask(docs, pii.fit(docs)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to; null and empty texts have no tokens."""
    small_batches(spark)
    return bpe.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

#: Classifiers, sketches and tokenizers are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            discard(before)
    return docs
