"""Streaming variant: features arrive, rasters are at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.grid import Grid
from quern.operators.rasterize import points_to_cells


def stream_points(features: DataFrame, pixels: DataFrame, g: Grid, bands: list[str]) -> DataFrame:
    """Arriving points (fid, x, y) joined with their pixel: a stateless stream-static join."""
    return points_to_cells(features, g).join(pixels.select("col", "row", *bands), ["col", "row"])


def stream_zone_counts(features: DataFrame, pixels: DataFrame, g: Grid, time: str, window: str = "1 hour", late: str = "2 hours", band: str = "band1") -> DataFrame:
    """Pixels and sum of a band of arriving points by event-time window, closed ``late`` after the window."""
    hit = stream_points(features.withWatermark(time, late), pixels, g, [band])
    return hit.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col(band).cast("double")).alias(f"sum_{band}"))
