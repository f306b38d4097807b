"""Usage events as a stream: windowed counts with a watermark, and first-seen keys.

Extensions: what they extend is a log that is only appended to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window and kind; rows later than the watermark are left out."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    d = e.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("window_start"), by, "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, by: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events that follow each other in less than `gap`: begin, last event, count, total.

    As a stream, a session is given once the watermark has passed its end, and rows behind the
    watermark are left out.
    """
    e = events.withWatermark(time, late) if events.isStreaming else events
    d = e.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.max(time).alias("last"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(by, F.col("w.start").alias("begin"), "last", "n", F.round("total", 2).alias("total"))


def sliding(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Counts and sums per window of `width` that begins every `step`; a row counts in width / step windows."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    d = e.groupBy(F.window(time, width, step).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("window_start"), by, "n", F.round("total", 2).alias("total"))


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what there is, then stop; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
