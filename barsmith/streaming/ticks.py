"""Ticks to bars as a stream: beyond the batch engine's needs, with the same bars for the same ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of event-time windows. ticks: symbol, ts (timestamp), event_id, price. Repeated events count once while the watermark holds them; ticks later than that are dropped."""
    order = F.struct("ts", "event_id")
    seen = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    bars = seen.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
