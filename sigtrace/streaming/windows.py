"""Streams: the detectors hold no state and run on any stream; event counts take windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import detect_text


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value", slide: str | None = None) -> DataFrame:
    """Count and sum of value for each window and kind, tumbling or, with slide, sliding; on a stream, rows later than
    ``late`` are dropped."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(F.window(time, width, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Runs of events of one user that are less than gap apart: user, start, stop (last event and gap), number."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def stream_findings(spark: SparkSession, where: str, schema: str, out: str, checkpoint: str, keys: list[str], text: str = "text") -> StreamingQuery:
    """Watches a folder of Parquet files and appends the findings of new rows to another, once for all files present."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(where)
    found = detect_text(rows, keys, text)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
