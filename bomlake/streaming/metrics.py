"""Metrics of a stream of events, and files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and label; what comes later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def on_arrival(stream: DataFrame, apply, target: str, checkpoint: str):
    """Applies a batch operator to each set of files that arrives; results are folders batch=n of `target`, and a batch that runs again replaces its own."""
    write = lambda batch, n: apply(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
