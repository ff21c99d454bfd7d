"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import scratch_path

WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts the lineage, survives lost executors.

    Every call takes a new folder, so a retry never meets another run's files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the table stands in for the shuffles behind it
    before = spark.conf.get(freed)
    spark.conf.set(freed, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(freed, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Only A-Z become lower case; other letters stay. An all-ASCII text takes the quick built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def split_words(c: Column, separators: str) -> Column:
    """The non-empty pieces of ``c`` between runs of ``separators`` (a character class); null gives none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def digest_of_strings(strings: Column) -> Column:
    """Lower-case hex SHA-256 of an array of strings joined by commas."""
    return F.sha2(F.array_join(strings, ","), 256)
