"""A stored report that a stream keeps up to date, with exactly-once effect over restarts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claridoc.operators import ledger

BUCKETS = 64


def _versions(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All versions of all buckets; empty before the first batch."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(whole).parquet(os.path.join(folder, "rows"))
    except Exception as e:  # noqa: BLE001  only a folder that is not there yet counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], whole)


def _newest(versions: DataFrame) -> DataFrame:
    last = versions.select("bucket", "batch").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))  # a row a bucket
    return versions.join(F.broadcast(last), ["bucket", "batch"])


def merge_batch(updates: DataFrame, number: int, folder: str, values: list[str], buckets: int = BUCKETS) -> None:
    """Merge one micro-batch of updates (doc_id, agent, ts, event_id and ``values``) into the report.

    The report lies in buckets of documents. A batch writes a new version, under its number, of the buckets it touches, out of
    their newest versions with a lower number; it never reads what it wrote itself. A batch that is run again after a crash
    therefore writes the same rows to the same places.
    """
    latest = ledger.latest_rows(updates, values).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in latest.select("bucket").distinct().collect()]  # ``buckets`` at most
    if not touched:
        return
    before = _versions(updates.sparkSession, folder, latest.drop("bucket").schema).where(F.col("bucket").isin(touched) & (F.col("batch") < number))
    both = _newest(before).drop("batch").unionByName(latest)
    merged = ledger.latest_rows(both, [*values, "bucket"]).withColumn("batch", F.lit(number).cast("bigint"))
    merged.repartition(len(touched), "bucket").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(os.path.join(folder, "rows"))


def read_report(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The newest version of every bucket. ``schema``: doc_id, agent, ts, event_id and the values."""
    return _newest(_versions(spark, folder, schema)).select(*schema.names)


def upsert_stream(updates: DataFrame, values: list[str], folder: str, buckets: int = BUCKETS) -> str:
    """Run a stream of updates over all that is there into the report below ``folder``; returns the report's place. Goes on from its checkpoint."""
    place = os.path.join(folder, "report")
    run = (
        updates.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, place, values, buckets))
        .option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return place
