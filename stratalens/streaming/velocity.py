"""Incremental window counts: the streaming form of the velocity aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per key and tumbling window; late rows up to the watermark are counted."""
    at = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = at.groupBy(F.window("_ts", window), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n")
