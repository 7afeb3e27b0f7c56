"""Lookup joins over pixel tables: point extraction, CSV update, calibration, spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.grid import Grid, col_of, row_of
from quern.operators.extract import paired
from quern.operators.select import first_nonzero


def add_band_values(rows: DataFrame, rasters: list[tuple[Grid, DataFrame, str]], bands: list[str], by: str = "xy") -> DataFrame:
    """``rows`` with ``Band_<b>_<raster>`` columns at (x, y), or at col, row counted from 1; null outside a raster."""
    out = rows
    for g, pixels, name in rasters:
        c, r = (col_of("x", g), row_of("y", g)) if by == "xy" else (F.col("col") - 1, F.col("row") - 1)
        values = pixels.select(F.col("col").alias("__c"), F.col("row").alias("__r"), *(F.col(b).alias(f"Band_{k + 1}_{name}") for k, b in enumerate(bands)))
        out = out.withColumns({"__col": c, "__row": r}).join(values, (F.col("__col") == F.col("__c")) & (F.col("__row") == F.col("__r")), "left")
        out = out.drop("__col", "__row", "__c", "__r")
    return out


def per_feature_raster(features: DataFrame, field: str, rasters: DataFrame, pixels: DataFrame, bands: list[str], directory: str = "") -> DataFrame:
    """(fid, path, col, row, bands): each point's pixel in the raster that its field names (cells count from 0)."""
    path = F.concat(F.lit(directory.rstrip("/") + "/" if directory else ""), F.col(field))
    f = features.withColumn("path", path).join(rasters.select("path", "rid", "x0", "y0", "px", "py"), "path")
    cell = lambda v, o, s: F.floor((F.col(v) - F.col(o)) / F.col(s)).cast("int")
    f = f.withColumns({"col": cell("x", "x0", "px"), "row": cell("y", "y0", "py")})
    return f.join(pixels, ["rid", "col", "row"]).select("fid", "path", "col", "row", *bands)


def extract_points(features: DataFrame, rasters: DataFrame, pixels: DataFrame, bands: list[str], skip=()) -> DataFrame:
    """(fid, idx, col, row, bands): nearest cell in the first raster (by ``idx``) whose pixel is not zero there.

    ``rasters``: the list of rasters, ``pixels`` (rid, col, row, bands) of all. Points meet rasters by tiles, half a
    pixel beyond their edges, where the nearest cell may still be one of theirs.
    """
    f = features if not skip else features.where(~F.col("fid").isin(list(skip)))
    half = rasters.agg(F.max(F.greatest(F.abs("px"), F.abs("py")))).first()[0] or 0.0
    f = f.select("fid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    f = f.withColumns({"minx": F.col("x") - half, "maxx": F.col("x") + half, "miny": F.col("y") - half, "maxy": F.col("y") + half})
    near = paired(f, rasters.select("idx", "rid", "width", "height", "x0", "y0", "px", "py"), "full")
    cell = lambda v, o, s: F.round((F.col(v) - F.col(o)) / F.col(s)).cast("int")  # noqa: E731  halves away from zero
    near = near.select("fid", "idx", "rid", cell("x", "x0", "px").alias("col"), cell("y", "y0", "py").alias("row"))
    return first_nonzero(near.join(pixels.select("rid", "col", "row", *bands), ["rid", "col", "row"]), bands).select("fid", "idx", "col", "row", *bands)


def check_speclib(columns: list[str], link: str, n_bands: int) -> None:
    """The first column is the link and one column a band follows."""
    if not columns or columns[0] != link or len(columns) - 1 != n_bands:
        raise ValueError("a spectral library has the link and one column a band")


def calibration(speclib: DataFrame, stats: DataFrame, link: str, bands: list[str], wanted: list[str]) -> DataFrame:
    """(FID, link, RID, BandNumber, FieldBandValue, <stat>_ImageBandValue), a row a raster, spectrum and band.

    ``stats`` has fid, rid, the link and ``<stat>_<band>``; statistics other than avg, mode, stdev, min, max read 0.
    """
    check_speclib(speclib.columns, link, len(bands))
    filled = {"avg", "mode", "stdev", "min", "max"}
    long = speclib.select(link, F.posexplode(F.array(*(F.col(c).cast("double") for c in speclib.columns[1:]))).alias("k", "FieldBandValue"))
    image = stats.select(
        F.col("fid").alias("FID"), link, F.col("rid").alias("RID"),
        F.posexplode(F.array(*(F.struct(*((F.col(f"{s}_{b}") if s in filled else F.lit(0.0)).cast("double").alias(f"{s}_ImageBandValue") for s in wanted)) for b in bands))).alias("k", "v"),
    )
    return long.join(image, [link, "k"]).select("FID", link, "RID", (F.col("k") + 1).alias("BandNumber"), "FieldBandValue", "v.*")


def spectra(extracted: DataFrame, g: Grid, bands: list[str], fields: list[str] = []) -> DataFrame:
    """(name, spectrum, fields): one spectrum a pixel, named ``FID:col:row:x:y``."""
    from quern.functions.grid import grid_x, grid_y

    name = F.concat_ws(":", "fid", "col", "row", F.format_string("%f", grid_x("col", g)), F.format_string("%f", grid_y("row", g)))
    return extracted.select(name.alias("name"), F.array(*(F.col(b).cast("double") for b in bands)).alias("spectrum"), *fields)
