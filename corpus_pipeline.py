"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and returns them
without the rows it rejects, in the columns of ``docs``; the last returns the pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm import decontaminate, exact_dedup, pieces, simhash, toxicity
from eventframe.llm.common import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that a model of ``labels`` doesn't judge toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return simhash.keep_first(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no item of ``benchmark`` leaks."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, ids, lossless)`` of every row."""
    return pieces.encode(docs).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "lossless")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", leaked), ("sentencepiece", encoded)]

#: SQL can't express the fingerprints, the classifier or the tokenizer; a brute-force version checks ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
