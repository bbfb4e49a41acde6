"""An incremental profile of an event stream: mergeable statistics by time window.

An extension beyond the batch operators: the same column statistics, kept up to date by Structured
Streaming with a watermark.  A window is appended to the table when the watermark has passed its end, and leaves the state then, which
is so bounded by the windows still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(events: DataFrame, ts: str, key: str, value: str, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(window_start, key, n, non_null, value_min, value_max, value_sum) for batch and streaming frames alike."""
    df = events.withWatermark(ts, lateness) if events.isStreaming else events
    return (
        df.groupBy(F.window(ts, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("non_null"), F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.sum(F.col(value).cast("decimal(18,4)")).alias("value_sum"))
        .select(F.col("w.start").alias("window_start"), key, "n", "non_null", "value_min", "value_max", F.col("value_sum").cast("double").alias("value_sum"))
    )


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str):
    """Start the query, which appends closed windows to the Parquet table in ``folder`` and stops when all that is there now is processed."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
