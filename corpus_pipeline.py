"""A training-data pipeline over ``documents``: five stages, each calling one operator.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps; the driver (or
:func:`run`) writes what a stage returns as Parquet and reads it again for the next one.
All but the last return the columns of ``docs``; the last adds ``copy_no``, the number of the
copy of a document in the mixture. Empty tables, nulls and clashing columns are handled by the
operators as their docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontam, exact, langid, mixing, simhash
from folio.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no learned language is recognised go."""
    return langid.recognised(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return simhash.without_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("source_mix", mixture),
]

#: Language ID and SimHash classes cannot be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
