"""Corpus pipeline: identify languages, drop exact and near duplicates, drop benchmark leaks, encode as pieces.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and, but for the last,
returns the columns of ``documents``. Each result is written as Parquet and read again, so a lost executor
repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import checkpointed, table
from plumbline.llm.decontaminate import drop_leaks
from plumbline.llm.exact_dedup import drop_exact_duplicates
from plumbline.llm.langid import keep_identified
from plumbline.llm.pieces import default_model, encode_pieces
from plumbline.llm.simhash import drop_near_duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows whose language stays undetermined go (no text, no letter, or no clear language)."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the row with the largest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the row with the smallest id stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows that hold a passage of the benchmark go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: piece ids of every row that is left, checked by decoding."""
    return encode_pieces(docs, default_model())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]
#: The classifier, the fingerprints and the alignment have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    checkpointed(spark.range(0))  # makes sure that a shared folder is set
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
