"""Streaming forms of the per-row and event-time operators, for signals that arrive while they are recorded.

Inputs are streaming (or batch) frames with subject_id, ts (timestamp), value. Lateness is bounded by a
watermark, so state is dropped once a window can't change any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outside_by_window(signal: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """subject_id, window, samples outside their limits (columns lower, upper) and all samples."""
    out = ~F.col("value").between(F.col("lower"), F.col("upper"))
    grouped = signal.withWatermark("ts", lateness).groupBy("subject_id", F.window("ts", width))
    return grouped.agg(F.count_if(out).alias("outside"), F.count("value").alias("samples")).select("subject_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "outside", "samples")


def window_means(signal: DataFrame, width: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Mean of each (sliding) window; the mean rule's input."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return signal.withWatermark("ts", lateness).groupBy("subject_id", w).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).select("subject_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def sessions(signal: DataFrame, gap: str = "61 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap, with their extent and size."""
    s = signal.where("value is not null").withWatermark("ts", lateness).groupBy("subject_id", F.session_window("ts", gap))
    return s.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("subject_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")
