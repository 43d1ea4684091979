"""Cleaning pipeline over documents: five stages, each working on all that the one before kept.

1. language: documents whose text no language is near enough to go
2. near_copies: of each group of near copies (five-word shingles, 0.8) the smallest id stays
3. benchmark: documents that hold a test item go
4. secrets: secrets are masked in the text
5. pieces: every text is encoded and decoded

Filtering stages keep all columns of documents, and rows with null texts only as far as their rule says: a null or empty
text has no language, so stage 1 drops it.  SQL cannot express the stages; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pacelane.llm.decontam import drop_leaks
from pacelane.llm.frames import settle
from pacelane.llm.language import fit_language, keep_identified
from pacelane.llm.neardup import drop_near_copies
from pacelane.llm.pieces import with_pieces
from pacelane.llm.queries import piece_model
from pacelane.llm.secrets import mask_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit_language(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_pieces(docs, piece_model())


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one kept is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else settle(docs), sf_dir)
    return docs
