"""Streaming quadrat counts: late events are kept out by a watermark, state is bounded by windows and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(size: float) -> tuple[Column, Column]:
    return F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy")


def counts(events: DataFrame, size: float, every: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, cx, cy, n, total) of (ts, x, y, value), tumbling or sliding; a stream or a table."""
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(window.alias("w"), *cell(size)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "cx", "cy", "n", "total")


def sessions(events: DataFrame, size: float, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, cx, cy, n): runs of events in a cell without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *cell(size)).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cx", "cy", "n")


def hot_cells(counted: DataFrame, threshold: float) -> DataFrame:
    """Cells with at least ``threshold`` events in a window."""
    return counted.where(F.col("n") >= threshold)
