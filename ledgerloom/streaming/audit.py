"""Extension: audit events and chat profiles as streams. The batch operators do the same work; nothing else depends on this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def landed_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 100) -> DataFrame:
    """Events as files land below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event once; state older than the watermark is dropped, and later repeats of it are late."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of closed windows."""
    counted = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the audit log; the checkpoint makes each batch count once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
