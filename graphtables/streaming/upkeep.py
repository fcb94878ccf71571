"""Upkeep of graph statistics over streams of edges and events, by Structured Streaming's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_events(events: DataFrame, time: str, by: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, by, n): events per tumbling window and key; rows later than ``late`` are dropped by the watermark. Batch input works too."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def new_edges(edges: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Edges once each, within the watermark."""
    return edges.withWatermark(time, late).dropDuplicatesWithinWatermark(["src", "dst"]) if edges.isStreaming else edges.dropDuplicates(["src", "dst"])


def running_degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree) over all edges so far; on a stream for output modes update and complete."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
