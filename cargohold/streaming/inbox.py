"""Streams: container files that arrive in a folder, and event streams (extensions of Spark's; the reference has none)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.scratch import scratch_path
from cargohold.sources import containers


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """Item rows of container files as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return containers.items_of(containers.detected(files.select(F.col("path").alias("container_id"), "content")))


def stored(items: DataFrame, path: str, checkpoint: str):
    """Appends each batch of item rows to a Parquet table partitioned by module, until what is there has been read."""
    return items.writeStream.format("parquet").partitionBy("module").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream, with `at` as event time."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    return source.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream after all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream_checkpoint")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
