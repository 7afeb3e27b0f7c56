"""Choice of one raster per feature among overlapping ones (duplicate pixels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.grid import angle, centre, distance
from quern.operators.extract import exchanged, paired

DISTANCE_EPS = 1e-4
NODATA_EPS = 1e-3
#: Degrees within which directions tie, and times the best distance within which distances tie.
ANGLE_TIE = 5.0
DISTANCE_TIE = 6.0


def candidates(features: DataFrame, rasters: DataFrame, edge_mode: str = "reference") -> DataFrame:
    """(fid, idx, rid, dx, dy) of rasters whose bounding box holds the feature's."""
    cx, cy = centre()
    rx, ry = (F.col("rminx") + F.col("rmaxx")) / F.lit(2.0), (F.col("rminy") + F.col("rmaxy")) / F.lit(2.0)
    held = paired(features.select("fid", "minx", "miny", "maxx", "maxy"), rasters, edge_mode, holds=True)
    return held.select("fid", "idx", "rid", (cx - rx).alias("dx"), (cy - ry).alias("dy"))


def screen_nodata(cands: DataFrame, pixels: DataFrame, bands: list[str], nodata, mode: str = "all_bands") -> DataFrame:
    """Without rasters that have a pixel of nodata under the feature. ``pixels``: (fid, rid, bands).

    ``nodata``: a number, or a column of ``pixels``, where null means that the raster has none.
    ``mode``: ``all_bands``, ``any_band`` or ``band <n>`` (from 1).
    """
    value = nodata if isinstance(nodata, Column) else F.lit(float(nodata))
    hit = lambda b: F.coalesce(F.abs(F.col(b) - value) <= NODATA_EPS, F.lit(False))
    if mode.startswith("band "):
        bad = hit(bands[int(mode.split()[1]) - 1])
    else:
        bad = hit(bands[0])
        for b in bands[1:]:
            bad = bad & hit(b) if mode == "all_bands" else bad | hit(b)
    return exchanged(cands).join(pixels.where(bad).select("fid", "rid").distinct(), ["fid", "rid"], "left_anti")


def screen_masks(cands: DataFrame, mask_pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Without rasters whose mask is 0 in any band under the feature. ``mask_pixels``: (fid, rid, bands)."""
    bad = F.lit(False)
    for b in bands:
        bad = bad | (F.col(b) == 0)
    return exchanged(cands).join(mask_pixels.where(bad).select("fid", "rid").distinct(), ["fid", "rid"], "left_anti")


def choose(cands: DataFrame, modes: list[tuple], distance_tie: float = DISTANCE_TIE, angle_tie: float = ANGLE_TIE, wrap: bool = False) -> DataFrame:
    """(fid, idx, rid): the best candidate. ``modes``: ("distance",) or ("direction", degrees), in order.

    While a feature has more than one candidate, a mode keeps the best and its near ties; the last
    applied score, then the raster's place in the list decides.
    """
    by = Window.partitionBy("fid")
    cur = cands.withColumn("score", F.lit(0.0))
    for mode in modes:
        d = distance(F.col("dx"), F.col("dy"))
        if mode[0] == "distance":
            score, tie = d, lambda best: best * F.lit(float(distance_tie))
        elif mode[0] == "direction":
            off = F.abs(angle(F.col("dx"), F.col("dy")) - F.lit(float(mode[1])))
            off = F.least(off, F.abs(F.lit(360.0) - off)) if wrap else off
            score, tie = F.when(d <= DISTANCE_EPS, 0.0).otherwise(off), lambda best: best + F.lit(float(angle_tie))
        else:
            raise ValueError(f"unknown mode {mode[0]!r}")
        cur = cur.withColumn("__n", F.count(F.lit(1)).over(by))
        cur = cur.withColumn("score", F.when(F.col("__n") > 1, score).otherwise(F.col("score"))).withColumn("__best", F.min("score").over(by))
        cur = cur.where((F.col("__n") == 1) | (F.col("score") <= tie(F.col("__best")))).drop("__n", "__best")
    first = Window.partitionBy("fid").orderBy("score", "idx")
    return cur.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("fid", "idx", "rid")


def first_nonzero(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """First raster in list order with a non-zero pixel for each feature. ``pixels``: (fid, idx, bands...)."""
    some = F.lit(False)
    for b in bands:
        some = some | (F.col(b) != 0)
    w = Window.partitionBy("fid").orderBy("idx")
    return pixels.where(some).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
