"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Quality rules drop the documents they reject; line dedup drops repeated lines
inside documents (which stay, with ``n_chars`` counting what is left); MinHash
near-dedup leaves one document of each group; decontamination drops the
documents that hold a window of a benchmark item; mixing keeps the documents
that the mix takes and says how often (``epochs``). A stage works on all that
its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import decontaminate, line_dedup, mixing, near_dups, quality
from orderlens.llm.common import table
from orderlens.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken documents' columns, then size, source_size, target, epochs and taken (these replace like-named ones)."""
    new = ["size", "source_size", "target", "epochs", "taken"]
    mixed = mixing.mix(docs).filter("epochs > 0")
    return mixed.select(*(f"row.{c}" for c in docs.columns if c not in new), *new)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", source_mix),
]

#: SQL can't express the certified cutoffs and the budget fitting; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage reads what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, "pipeline", f"{k}-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
