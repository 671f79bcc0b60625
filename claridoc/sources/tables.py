"""Readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claridoc.functions import fixed_values as fv


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", max_bytes: int = fv.LIVE_MAX_BYTES) -> DataFrame:
    """Uploaded files as (path, bytes, head). The reader opens only files of up to ``max_bytes``; larger ones have no head.

    Length is filtered by the scan before it opens a file, and larger files are rejected by their length alone.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("bytes"), F.substring("content", 1, 5).cast("string").alias("head"))
    large = files.where(F.col("length") > max_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("head"))
    return small.unionByName(large)


def encode_base64(text: Column) -> Column:
    """Base-64 of the UTF-8 bytes, on one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def decode_base64(encoded: Column) -> Column:
    """Bytes of a base-64 text, with or without a PDF data prefix."""
    return F.unbase64(F.regexp_replace(encoded, r"^data:application/pdf;base64,", ""))


def write_report(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Store a report as parquet. Partition only by columns with few values."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to an append-only event log."""
    df.write.mode("append").parquet(path)
