"""The pixel table and its building blocks: lookups, stacking, filters, output columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.grid import Grid, dbl, grid_x, grid_y, rid_of


#: Cells of all rasters up to which every task gets their pixels, so that no cells are exchanged.
SMALL = 1 << 18


def join_pixels(cells: DataFrame, pixels: DataFrame, on: tuple[str, ...] = ("col", "row"), how: str = "inner", area: int | None = None) -> DataFrame:
    """Bands of each cell: an equi-join, whatever the geometry was.

    ``area``: how many cells the rasters have, where it is known. Pixels of up to :data:`SMALL` cells go to
    every task; with more of them both sides are exchanged. Without it the planner decides, which takes
    cells for as few as the features that they were made from and may send all of them through the driver.
    """
    if area is None:
        return cells.join(pixels, list(on), how)
    return cells.join(F.broadcast(pixels), list(on), how) if area <= SMALL else exchanged(cells).join(pixels, list(on), how)


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` with both sides of its next join exchanged.

    The planner knows the bytes of the files that a table is read from. Cells, and tables of ids stored as Parquet,
    are many times that in memory, and what it takes for small it sends to every task through the driver.
    """
    return df.hint("merge")


def tiled(df: DataFrame, size: int = 1024) -> DataFrame:
    """``df(col, row)`` with ``tile``, the square of ``size`` cells it lies in.

    Pixel tables written by tile (:func:`quern.sources.sinks.write_pixels`) are joined on rid, tile,
    col and row: the tiles that the cells touch are known at run time and prune the scan.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long")
    return df.withColumn("tile", at("row") * F.lit(1 << 20) + at("col"))


def band_values(cells: DataFrame, pixels: DataFrame, band: str, on: tuple[str, ...] = ("col", "row")) -> DataFrame:
    """``cells`` with one band's value, 0 outside the grid."""
    return cells.join(pixels.select(*on, F.col(band).alias("value")), list(on), "left").withColumn("value", F.coalesce(F.col("value"), F.lit(0)))


def check_same_grid(a: Grid, b: Grid) -> None:
    if any(getattr(a, k) != getattr(b, k) for k in ("width", "height", "x0", "y0", "px", "py")):
        raise ValueError("rasters of different size, corner or pixel size cannot be stacked")


def stack(first: DataFrame, second: DataFrame, first_grid: Grid, second_grid: Grid) -> DataFrame:
    """Bands of two rasters of exactly the same grid side by side; the second's are renumbered."""
    check_same_grid(first_grid, second_grid)
    bands = [c for c in first.columns if c.startswith("band")]
    more = [c for c in second.columns if c.startswith("band")]
    renamed = second.select("col", "row", *(F.col(c).alias(f"band{len(bands) + k + 1}") for k, c in enumerate(more)))
    return first.select("col", "row", *bands).join(renamed, ["col", "row"])


def select_fields(features: DataFrame, fields: list[str] | str | None) -> list[str]:
    """Attribute names of the output: all, the listed ones, or none."""
    own = [c for c in features.columns if c not in ("fid", "wkt", "minx", "miny", "maxx", "maxy", "kind")]
    if fields is None:
        return own
    wanted = [] if fields in ("none", ["none"]) else list(fields)
    if missing := [f for f in wanted if f not in own]:
        raise ValueError(f"fields not found: {missing}")
    return wanted


def pixel_table(
    extracted: DataFrame, g: Grid | None, attrs: list[str], bands: list[str], rid: str = "file", path: str = "path", col_row: bool = True, xy: bool = True,
) -> DataFrame:
    """FID, attributes, RID, col, row (from 1), x, y (pixel corner), bands. Without a grid, x0, y0, px, py are columns."""
    out = [F.col("fid").alias("FID"), *attrs]
    if (r := rid_of(path, rid)) is not None:
        out.append(r.alias("RID"))
    if col_row:
        out += [(F.col("col") + 1).alias("col"), (F.col("row") + 1).alias("row")]
    if xy:
        x, y = (grid_x("col", g), grid_y("row", g)) if g else (dbl("x0") + dbl("col") * dbl("px"), dbl("y0") + dbl("row") * dbl("py"))
        out += [x.alias("x"), y.alias("y")]
    return extracted.select(*out, *bands)


def by_fid(features: DataFrame, fid: int) -> DataFrame:
    """One feature; an error if there is none. Other filters do not apply to it."""
    out = features.where(F.col("fid") == fid)
    if out.isEmpty():
        raise ValueError(f"no feature with FID {fid}")
    return out


def by_field(features: DataFrame, field: str, value) -> DataFrame:
    """The first feature (by fid) whose field reads ``value``."""
    hit = features.where(F.col(field).cast("string") == str(value))
    return hit.join(hit.agg(F.min("fid").alias("fid")), "fid", "left_semi")


def without_fids(features: DataFrame, fids) -> DataFrame:
    """``features`` but those listed, or but those of another table."""
    return features.join(fids.select("fid"), "fid", "left_anti") if isinstance(fids, DataFrame) else features.where(~F.col("fid").isin(list(fids)))


def touching(features: DataFrame, g: Grid, edge_mode: str = "reference") -> DataFrame:
    """Features whose bounding box meets the raster: plain comparisons, which reach the scan."""
    a, b, c, d = g.envelope(edge_mode)
    return features.where((F.col("maxx") >= a) & (F.col("minx") <= c) & (F.col("maxy") >= b) & (F.col("miny") <= d))


def touching_any(features: DataFrame, rasters: DataFrame) -> DataFrame:
    """Features whose bounding box meets any raster's. ``rasters`` is the list of rasters, one row each."""
    near = paired(features.select("fid", "minx", "miny", "maxx", "maxy"), rasters).select("fid").distinct()
    return features.join(near, "fid", "left_semi")


def paired(features: DataFrame, rasters: DataFrame, edge_mode: str = "reference", holds: bool = False) -> DataFrame:
    """``features`` with each raster whose bounding box meets theirs (or ``holds`` it): an equi-join on coarse tiles.

    Tiles are as large as the largest raster, so a raster lies in four at most. A pair is made in one tile only,
    the first that both touch. Features without bounds have no pairs.
    """
    r = raster_bounds(rasters, edge_mode)
    size = r.agg(F.max(F.greatest(F.col("rmaxx") - F.col("rminx"), F.col("rmaxy") - F.col("rminy")))).first()[0] or 1.0
    tile = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("long")
    spread = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(tile(a), tile(b))))
    f = spread(spread(features.where("minx is not null and miny is not null"), "minx", "maxx", "__tx"), "miny", "maxy", "__ty")
    own = [c for c in r.columns if c not in features.columns]
    r = spread(spread(r.select(*own), "rminx", "rmaxx", "__tx"), "rminy", "rmaxy", "__ty")
    c = F.col
    if holds:
        meets = (c("rminx") <= c("minx")) & (c("maxx") <= c("rmaxx")) & (c("rminy") <= c("miny")) & (c("maxy") <= c("rmaxy"))
    else:
        meets = (c("maxx") >= c("rminx")) & (c("minx") <= c("rmaxx")) & (c("maxy") >= c("rminy")) & (c("miny") <= c("rmaxy"))
    once = (c("__tx") == F.greatest(tile("minx"), tile("rminx"))) & (c("__ty") == F.greatest(tile("miny"), tile("rminy")))
    return f.join(r, ["__tx", "__ty"]).where(meets & once).drop("__tx", "__ty")


def raster_bounds(rasters: DataFrame, edge_mode: str = "reference") -> DataFrame:
    """``rasters(x0, y0, px, py, width, height)`` with the corners of each envelope."""
    k = F.lit({"reference": 1, "full": 0}[edge_mode])
    x1 = F.col("x0") + F.col("px") * (F.col("width") - k)
    y1 = F.col("y0") + F.col("py") * (F.col("height") - k)
    return rasters.withColumns({"rminx": F.least("x0", x1), "rmaxx": F.greatest("x0", x1), "rminy": F.least("y0", y1), "rmaxy": F.greatest("y0", y1)})


def validate_inputs(rasters: DataFrame, vector_srs: str | None = None) -> DataFrame:
    """One row: ``same_srs``, ``same_pixel_size``, ``ok`` over rasters, masks and the vector's SRS."""
    r = rasters.agg(
        F.count_distinct("srs").alias("n_srs"), F.count_distinct("px", "py").alias("n_px"), F.min("srs").alias("srs")
    )
    srs_ok = (F.col("n_srs") <= 1) & (F.lit(True) if vector_srs is None else F.coalesce(F.col("srs") == vector_srs, F.lit(True)))
    return r.select(srs_ok.alias("same_srs"), (F.col("n_px") <= 1).alias("same_pixel_size"), (srs_ok & (F.col("n_px") <= 1)).alias("ok"))
