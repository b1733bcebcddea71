"""Extension: the routing ratio over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_ratio(events: DataFrame, tau: float, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Share of events below ``tau`` by tumbling window and type, with a watermark; batch tables work too."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width), "event_type")
    return g.agg(F.avg(F.when(F.col("value") < tau, 1.0).otherwise(0.0)).alias("rho"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "rho", "n")
