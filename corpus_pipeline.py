"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet to the shared folder and read
again as the next one's ``docs``. Extra columns and nulls ride along; every
operator's docstring states what it does with nulls, empty texts, ties,
repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import bpe, dedup, mixing, simhash, subword
from lodestar.llm.common import begin, fold, table, written
from lodestar.llm.queries import digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    begin(spark)
    return subword.kept_rows(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 5, 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text: the one with the largest id."""
    begin(spark)
    return dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near duplicates: the one with the smallest id."""
    begin(spark)
    return simhash.kept_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    begin(spark)
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, one row for each copy in the mix."""
    begin(spark)
    return bpe.encode(docs, ["doc_id"]).select(F.col("doc")["doc_id"].alias("doc_id"), *digests())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near),
          ("mixing sources to target weights", mixed), ("BPE encoding and decoding", encoded)]

#: the classifier, the fingerprints and the encoding can't be expressed in SQL;
#: tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
