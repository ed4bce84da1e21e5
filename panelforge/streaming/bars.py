"""Streaming variants: periods of readings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import number


def bars(readings: DataFrame, period: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``ticker, start, px, volume, n`` per period of event time; readings later than ``late`` are left out, nulls and NaN are no observations.

    Works on a batch too, where nothing is late.
    """
    rows = readings.select("ticker", F.col("ts").cast("timestamp").alias("ts"), number("px").alias("px"), number("volume").alias("volume")).where("ticker is not null and ts is not null")
    if readings.isStreaming:
        rows = rows.withWatermark("ts", late)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("ts", c)))[c].alias(c)
    return rows.groupBy(F.window("ts", period).alias("w"), "ticker").agg(last("px"), last("volume"), F.count("*").alias("n")).select("ticker", F.col("w.start").alias("start"), "px", "volume", "n")
