"""Streams: windowed counts and deduplication under a watermark, for any streaming or plain frame with a time column."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.shared import shared_dir


def windowed(events: DataFrame, window: Column, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind; a stream drops what comes later than ``late``."""
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return windowed(events, F.window("ts", width))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return windowed(events, F.window("ts", width, step))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key: in a stream within the watermark, else of all."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what its source holds, in append mode, to a table in the shared folder; return the table.

    The checkpoint lies beside it, so that a restarted query goes on where it stopped.
    """
    path = f"{shared_dir(spark)}/storyloom/stream-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    pattern = f"{name}.parquet"
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", os.path.basename(pattern)).parquet(f"{sf_dir}/")
