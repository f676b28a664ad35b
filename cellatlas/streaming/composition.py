"""Running compositions: the batch operator's counts over cells that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arriving_composition(cells: DataFrame, time: str | None = None, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """cluster_id and n of a stream of cells; with a time column by window, late cells counted until the watermark passes.

    Its state is one number for each cluster (and open window), so it doesn't grow with the cells.
    """
    if time is None:
        return cells.groupBy("cluster_id").agg(F.count("*").alias("n"))
    windows = cells.withWatermark(time, late).groupBy(F.window(time, window), "cluster_id").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "cluster_id", "n")
