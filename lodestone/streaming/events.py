"""Event streams: windows, sessions and incremental registration with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(events: DataFrame) -> DataFrame:
    """With ``ts`` as a timestamp, as watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) for each window and type; ``late`` sets a watermark."""
    events = event_time(events)
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    out = event_time(events).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, n): runs of a user's events with gaps shorter than ``gap``."""
    out = event_time(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(path)


def register(arrivals: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("sha256",), late: str = "7 days") -> StreamingQuery:
    """Writes each new key once, within the watermark on ``arrived``; runs over what is there and stops."""
    fresh = arrivals.withWatermark("arrived", late).dropDuplicatesWithinWatermark(list(keys))
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
