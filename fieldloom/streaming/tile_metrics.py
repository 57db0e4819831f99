"""Streaming extension: pixel confusion counts by tile and window, from an unbounded event source.

The counts are mergeable sums, so state is four numbers for each open window and tile, and the
watermark closes windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_confusion(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events: ts, tile, gt, pred. One row for each window and tile once the watermark has passed it."""
    g, p = F.col("gt").isNotNull(), F.col("pred").isNotNull()
    counts = {"tp": g & p, "fp": ~g & p, "fn": g & ~p, "tn": ~g & ~p}
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "tile")
    return grouped.agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).select(F.col("window.start").alias("start"), "tile", *counts)
