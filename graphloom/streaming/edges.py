"""Streaming edges: running counts of a growing edge stream, with event-time windows and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(events: DataFrame, key: str = "user_id", time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n): edges of each node and window; works on a stream and on a table alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what its source holds now and return the sink's table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
