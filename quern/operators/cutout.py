"""Cut-outs, strips and burned rasters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.geom import parse_wkt, to_wkt, translated
from quern.functions.grid import Grid, grid_x, grid_y, parity_pad, rid_of
from quern.operators.extract import exchanged, join_pixels
from quern.operators.stats import extents


def cutout_windows(cells: DataFrame, g: Grid | DataFrame, prefix: str = "", parity: str | None = None, keys: list[str] = ["fid"], suffix: str = ".img") -> DataFrame:
    """(keys, name, col0, row0, width, height, ulx, uly): the window of each feature's cells; parity adds a column or row.

    ``g``: the grid, or the list of rasters if ``keys`` has rid.
    """
    e = extents(cells, keys)
    w, h = F.col("max_col") - F.col("min_col") + 1, F.col("max_row") - F.col("min_row") + 1
    if isinstance(g, DataFrame):
        e = e.join(g.select("rid", "x0", "y0", "px", "py"), "rid")
        ulx, uly = F.col("x0") + F.col("min_col") * F.col("px"), F.col("y0") + F.col("min_row") * F.col("py")
    else:
        ulx, uly = grid_x("min_col", g), grid_y("min_row", g)
    return e.select(
        *keys, F.concat(F.lit(prefix), F.format_string("%04d", F.col("fid")), F.lit(suffix)).alias("name"),
        F.col("min_col").alias("col0"), F.col("min_row").alias("row0"),
        (w + parity_pad(w, parity)).alias("width"), (h + parity_pad(h, parity)).alias("height"), ulx.alias("ulx"), uly.alias("uly"),
    )


def window_cells(windows: DataFrame, keys: list[str] = ["fid"]) -> DataFrame:
    """Every cell of each window: (keys, col, row, c, r), the last two relative to the window."""
    out = windows.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return out.select(*keys, (F.col("col0") + F.col("c")).alias("col"), (F.col("row0") + F.col("r")).alias("row"), "c", "r")


def filled(cells: DataFrame, pixels: DataFrame, bands: list[str], inside: DataFrame | None, fill, keys: list[str], area: int | None = None) -> DataFrame:
    """``cells(keys, col, row)`` with their bands: ``fill`` (a number, or by raster a column of ``pixels``' list) where there is no pixel, or outside ``inside``."""
    on = [k for k in keys if k == "rid"] + ["col", "row"]
    out = join_pixels(cells, pixels.select(*on, *bands), on, "left", area)
    if isinstance(fill, DataFrame):  # (rid, fill)
        out = out.join(fill, "rid", "left")
        other = F.coalesce("fill", F.lit(0.0))
    else:
        other = F.lit(float(fill))
    known = F.lit(True)
    if inside is not None:
        out = exchanged(out).join(inside.select(*keys, "col", "row").distinct().withColumn("__in", F.lit(True)), [*keys, "col", "row"], "left")
        known = F.coalesce("__in", F.lit(False))
    kinds = dict(pixels.dtypes)
    return out.withColumns({b: F.when(known & F.col(b).isNotNull(), F.col(b)).otherwise(other.cast(kinds[b])) for b in bands}).drop("__in", "fill")


def cutouts(cells: DataFrame, pixels: DataFrame, g: Grid | DataFrame, bands: list[str], only_inside: bool = False, nodata=0.0, parity: str | None = None, keys: list[str] = ["fid"], area: int | None = None) -> DataFrame:
    """(keys, c, r, bands): the pixels of each cut-out; those outside the geometry are nodata if ``only_inside``."""
    full = window_cells(cutout_windows(cells, g, parity=parity, keys=keys), keys)
    return filled(full, pixels, bands, cells if only_inside else None, nodata, keys, g.area if isinstance(g, Grid) else area).select(*keys, "c", "r", *bands)


def strip_layout(windows: DataFrame, separation: int = 0) -> DataFrame:
    """``windows`` with ``strip_row``: each cut-out starts below those of lesser fid.

    One row a feature, ordered by fid: running sums are taken within ranges of fid, and the ranges'
    totals (as many as exchange partitions) are added, so no task sorts all features.
    """
    from quern.session import stored

    h = F.col("height") + separation
    dealt = stored(windows.repartitionByRange("fid").withColumn("__pid", F.spark_partition_id()), "strip")
    own = Window.partitionBy("__pid").orderBy("fid").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("__own", F.coalesce(F.sum(h).over(own), F.lit(0)))
    ranges = dealt.groupBy("__pid").agg(F.sum(h).alias("__h"))
    before = ranges.withColumn("__before", F.coalesce(F.sum("__h").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.drop("__h"), "__pid").withColumn("strip_row", (F.col("__own") + F.col("__before")).cast("long")).drop("__pid", "__own", "__before")


def strip_size(layout: DataFrame) -> DataFrame:
    """(strip_width, strip_height)."""
    return layout.agg(F.max("width").alias("strip_width"), F.max(F.col("strip_row") + F.col("height")).alias("strip_height"))


def strip_pixels(layout: DataFrame, pixels: DataFrame, g: Grid | DataFrame, bands: list[str], fill=0.0, inside: DataFrame | None = None, keys: list[str] = ["fid"], area: int | None = None) -> DataFrame:
    """The three strips in one relation: (strip_col, strip_row, bands, fid, x, y).

    Covered cells only: elsewhere the data strip reads ``fill``, the fid strip -1 and the location
    strip 0 (see :func:`strip_full`). Locations are float32. With ``inside`` (cells of the features), cells
    of a cut-out outside its feature read ``fill``.
    """
    full = window_cells(layout.withColumn("__top", F.col("strip_row")), [*keys, "__top"])
    cells = filled(full, pixels, bands, inside, fill, keys, g.area if isinstance(g, Grid) else area)
    if isinstance(g, DataFrame):
        cells = cells.join(g.select("rid", "x0", "y0", "px", "py"), "rid")
        x, y = F.col("x0") + F.col("col") * F.col("px"), F.col("y0") + F.col("row") * F.col("py")
    else:
        x, y = grid_x("col", g), grid_y("row", g)
    return cells.select(F.col("c").alias("strip_col"), (F.col("__top") + F.col("r")).alias("strip_row"), *bands, "fid", x.cast("float").alias("x"), y.cast("float").alias("y"))


def strip_full(layout: DataFrame, covered: DataFrame, bands: list[str], fill: float = 0.0) -> DataFrame:
    """Every cell of the strip, filled where no cut-out lies. The strip's lines are dealt to tasks, whatever its height."""
    width, height = strip_size(layout).first()
    lines = layout.sparkSession.range(height or 0).select(F.col("id").alias("strip_row"))
    grid = lines.withColumn("strip_col", F.explode(F.sequence(F.lit(0), F.lit((width or 1) - 1))))
    out = grid.select("strip_col", "strip_row").join(covered, ["strip_col", "strip_row"], "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)).cast("float").alias(n)
    kinds = dict(covered.dtypes)
    return out.select("strip_col", "strip_row", *(F.coalesce(F.col(b), F.lit(float(fill)).cast(kinds[b])).alias(b) for b in bands), F.coalesce("fid", F.lit(-1)).alias("fid"), zero("x"), zero("y"))


def strip_vector(features: DataFrame, layout: DataFrame, g: Grid | DataFrame) -> DataFrame:
    """Features moved so that their box's upper-left corner lies at their cut-out's place in the strip: (fid, dx, dy, minx..maxy)."""
    f = features.select("fid", "minx", "miny", "maxx", "maxy")
    if isinstance(g, DataFrame):
        f = f.join(layout.select("fid", "rid", "strip_row", "ulx", "uly"), "fid").join(g.select("rid", "px", "py"), "rid")
        px, py = F.col("px"), F.col("py")
    else:
        f = f.join(layout.select("fid", "strip_row", "ulx", "uly"), "fid")
        px, py = F.lit(g.px), F.lit(g.py)
    left, top = F.when(px > 0, F.col("minx")).otherwise(F.col("maxx")), F.when(py > 0, F.col("miny")).otherwise(F.col("maxy"))
    f = f.withColumns({"dx": (left - F.col("ulx")) - left, "dy": (top - F.col("uly")) + F.col("strip_row") * py - top})
    return f.select("fid", "dx", "dy", *((F.col(n) + F.col("dx" if n.endswith("x") else "dy")).alias(n) for n in ("minx", "miny", "maxx", "maxy")))


def strip_features(features: DataFrame, layout: DataFrame, g: Grid | DataFrame, rid: str = "file") -> DataFrame:
    """The vector output of a strip: ``features`` (attributes kept) with moved geometry, and their RID."""

    @F.pandas_udf("string")
    def moved(wkt: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else to_wkt(translated(parse_wkt(w), a, b)) for w, a, b in zip(wkt, dx, dy)], dtype=object)

    at = strip_vector(features, layout, g).select("fid", "dx", "dy")
    if isinstance(g, DataFrame):
        at = at.join(layout.select("fid", F.col("rid").alias("RID")), "fid")
        name = rid_of("RID", rid)
    else:
        name = rid_of(F.lit(g.rid), rid)
    out = features.drop("minx", "miny", "maxx", "maxy").join(at, "fid").withColumn("wkt", moved("wkt", "dx", "dy")).drop("dx", "dy")
    return out.drop("RID") if name is None else out.withColumn("RID", name)


def crop(pixels: DataFrame, col0: int, row0: int, width: int, height: int, g: Grid) -> tuple[DataFrame, Grid]:
    """Pixels of a window, renumbered, and the window's grid."""
    inside = F.col("col").between(col0, col0 + width - 1) & F.col("row").between(row0, row0 + height - 1)
    x0, y0 = g.corner(col0, row0)
    out = pixels.where(inside).withColumns({"col": F.col("col") - col0, "row": F.col("row") - row0})
    return out, Grid(width, height, x0, y0, g.px, g.py, g.rid, g.srs, g.nodata, g.rotation)


def burn(cells: DataFrame, g: Grid, value: int = 1, nodata: int = 0, full: bool = True) -> DataFrame:
    """(col, row, value): the constant where any feature lies, nodata elsewhere.

    The type is the least that holds the constant: unsigned byte (as smallint), else smallint, else int.
    """
    kind = "smallint" if -32768 <= value <= 32767 else "int"
    hit = cells.select("col", "row").distinct().withColumn("value", F.lit(value).cast(kind))
    if not full:
        return hit
    spark = cells.sparkSession
    rows = spark.range(g.height).select(F.col("id").cast("int").alias("row"))
    grid = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(g.width - 1))))
    return grid.join(hit, ["col", "row"], "left").select("col", "row", F.coalesce("value", F.lit(nodata)).cast(kind).alias("value"))
