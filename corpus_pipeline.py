"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns of
``documents``. ``run`` applies the stages one after the other; each result is written as
Parquet into the shared folder and read back as the next stage's input.

Defined cases: an empty table passes through; rows without text or letters are rejected by
the first stage; of a group of near-duplicates the smallest doc_id stays, of repeated rows
one; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocklens.llm import decontaminate, langid, mixing, near_dedup
from stocklens.llm.common import staged, table

ORACLE_SQL = None      # models, hashing and raking are not SQL: tests compare with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts that no language model explains go."""
    return langid.accepted_rows(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 at five words and a similarity of 0.8: one document of each component stays."""
    return near_dedup.kept_rows(docs, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark passage go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are sampled to the target weights."""
    return mixing.sample_rows(docs, mixing.make_plan(docs))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_free),
    ("mix_sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
