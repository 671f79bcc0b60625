"""Running streams over the stored tables, to the end, into a table that can be read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from claridoc.session import ROCKSDB


def streaming_session(spark: SparkSession) -> SparkSession:
    """A sibling session with the state store that keyed state needs.

    On one machine it also has no more state partitions than cores; a cluster keeps its own number.
    """
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    sibling.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if spark.sparkContext.master.startswith("local"):
        sibling.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return sibling


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="claridoc-stream-")
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def stream_of(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream."""
    path = os.path.join(folder, f"{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a pattern, since a stream source takes no plain file
    return reader.parquet(f"{path}*")


def drain(stream: DataFrame, folder: str | None = None) -> str:
    """Run a stream over all that is there, into parquet with exactly-once file commits; returns the path.

    Called again with the same folder it goes on where it stopped.
    """
    base = folder or shared_folder(stream.sparkSession)
    out = os.path.join(base, "out")
    run = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(base, "state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return out
