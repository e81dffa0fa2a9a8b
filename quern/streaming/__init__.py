"""Continuous forms of the profile: windowed moments over a stream with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, least and greatest of each column by window of event time; works on tables too."""
    at = F.col(time).cast("timestamp")
    df = stream.withColumn(time, at)
    df = df.withWatermark(time, late) if stream.isStreaming else df
    aggs = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(F.window(time, window).alias("w")).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")
