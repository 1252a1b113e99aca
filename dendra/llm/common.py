"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Rows per Arrow batch handed to Python: whole texts, so batches stay small.
TEXT_BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark (any store Spark can reach)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null as empty) and the named columns; every
    other column is dropped, so clashing names never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def n_words(text: Column) -> Column:
    """Number of words (``WORD``) of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_training(doc_id: Column) -> Column:
    """Rows that models may learn from: crc32 of the id as text, mod 3, not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small (bounded worker memory)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions_for(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
