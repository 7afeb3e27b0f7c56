"""Aggregations over extracted pixels: zonal statistics, class counts, extents, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("sum", "min", "max", "avg", "var", "stdev", "mode", "median", "nulls")
#: Multiplier of the split of a double in two halves of 26 bits.
SPLIT = float((1 << 27) + 1)


def three_decimals(v: Column) -> Column:
    """Values as ``%.3f`` rounds them, by their exact binary value. Expressions only.

    The JVM rounds the shortest decimal of a double, which differs only where that is a tie: there the
    exact product with 10 000, in two halves, tells which side the binary value is on (halves of exact
    ties go to even). From 2^39 on a double's decimal text is taken as it is.
    """
    a = F.abs(v)
    x = a * F.lit(10000.0)
    m = F.floor(x + F.lit(0.5)).cast("double")
    tie = (m % 10 == 5) & (F.abs(x - m) < F.lit(1e-3)) & (a < F.lit(float(1 << 39)))
    c = a * F.lit(SPLIT)
    high = c - (c - a)
    off = (high * F.lit(10000.0) - m) + (a - high) * F.lit(10000.0)
    k = F.floor(m / 10)
    k = k + F.when(off > 0, 1).when(off < 0, 0).otherwise(k % 2)
    text = F.concat(F.when(v < 0, "-").otherwise(""), F.floor(k / 1000).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    return F.when(v.isNull() | F.isnan(v), None).when(tie, text).otherwise(F.format_string("%.3f", v))


def valid(band: Column, nodata) -> Column:
    """``band`` with nodata (a number, or a column that may be null) as null. A NaN nodata matches NaN."""
    if nodata is None:
        return band
    if isinstance(nodata, Column):
        return F.when(nodata.isNull() | ~(band.cast("double") == nodata), band)
    return F.when(~(band.cast("double") == F.lit(float(nodata))), band)


def is_float(df: DataFrame, bands) -> bool:
    """Any floating band puts all bands on the floating path."""
    kinds = dict(df.dtypes)
    return any(kinds[b] in ("float", "double") for b in bands)


def stat_column(name: str, v: Column, raw: Column, key: Column, floating: bool, compat: bool) -> Column:
    """One statistic of the valid values ``v`` of a group; ``key`` is the ``%.3f`` string of the floating path."""
    d = v.cast("double")
    some = F.count(v) > 0
    made = {
        "sum": lambda: F.sum(d), "min": lambda: F.min(d), "max": lambda: F.max(d), "avg": lambda: F.avg(d),
        "var": lambda: F.when(some, F.coalesce(F.var_samp(d), F.lit(0.0))),
        "stdev": lambda: F.when(some, F.coalesce(F.stddev_samp(d), F.lit(0.0))),
        "mode": lambda: F.mode(key, True).cast("double") if floating else F.mode(v, True).cast("double"),
        "median": lambda: F.median(d),
        "nulls": lambda: F.count(raw) - F.count(v),
    }[name]()
    if name == "nulls":
        return F.when(some, made).otherwise(F.lit(0)).cast("long") if compat else made.cast("long")
    return F.coalesce(made, F.lit(0.0)) if compat else made


def zonal_stats(
    pixels: DataFrame, bands: list[str], stats: list[str] = ["avg"], keys: list[str] = ["fid"], attrs: list[str] = [],
    nodata: float | dict | Column | None = None, compat: bool = False, numpixels: str = "numPixels",
) -> DataFrame:
    """One row a group: keys, attributes, numPixels, then ``<stat>_<Band>`` in the order stats, bands.

    ``pixels`` has each pixel of a feature once (see :func:`distinct_pixels`). Sums and extremes are
    partial aggregates before the exchange. ``compat`` reports 0 for groups of nodata alone.
    """
    if unknown := set(stats) - set(STATS):
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    floating = is_float(pixels, bands)
    of = lambda b: nodata.get(b) if isinstance(nodata, dict) else nodata  # noqa: E731  a column applies to all bands
    ready = pixels
    if floating and "mode" in stats:
        ready = ready.withColumns({f"__key_{b}": three_decimals(valid(F.col(b).cast("double"), of(b))) for b in bands})
    cols = [F.count(F.lit(1)).alias(numpixels)]
    for s in stats:
        for b in bands:
            v = valid(F.col(b), of(b))
            cols.append(stat_column(s, v, F.col(b), F.col(f"__key_{b}") if floating else v, floating, compat).alias(f"{s}_{b}"))
    return ready.groupBy(*keys, *attrs).agg(*cols)


def two_step_stats(pixels: DataFrame, bands: list[str], stats: list[str], keys: list[str], nodata=None, compat: bool = False, numpixels: str = "numPixels") -> DataFrame:
    """:func:`zonal_stats` from counts of values, so that no task holds the values of a whole raster.

    (keys, value) is counted first, with partial sums before the exchange; then the few different values of
    a group meet: of the mode the most frequent, of the median those about the middle by running counts.
    """
    rank = [s for s in stats if s in ("mode", "median")]
    rest = [s for s in stats if s not in rank]
    out = zonal_stats(pixels, bands, rest or ["nulls"], keys, nodata=nodata, compat=compat, numpixels=numpixels)
    floating = is_float(pixels, bands)
    for b in bands if rank else ():
        v = valid(F.col(b).cast("double"), nodata.get(b) if isinstance(nodata, dict) else nodata)
        counts = pixels.select(*keys, v.alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
        if "mode" in rank:
            value = three_decimals(F.col("v")) if floating else F.col("v")
            per = counts.groupBy(*keys, value.alias("k")).agg(F.sum("n").alias("n"))
            best = per.where("k is not null").groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "k")).alias("m")).select(*keys, F.col("m.k").cast("double").alias(f"mode_{b}"))
            out = out.join(best, keys, "left")
        if "median" in rank:
            below = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            run = counts.withColumns({"to": F.sum("n").over(below), "all": F.sum("n").over(Window.partitionBy(*keys))}).withColumn("from", F.col("to") - F.col("n") + 1)
            low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
            at = lambda k: F.max(F.when((F.col("from") <= k) & (k <= F.col("to")), F.col("v")))
            mid = run.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(f"median_{b}"))
            out = out.join(mid, keys, "left")
    cols = [f"{s}_{b}" for s in stats for b in bands]
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c) if compat and c.startswith(("mode_", "median_")) else F.col(c)
    return out.select(*keys, numpixels, *map(value, cols))


def distinct_pixels(cells: DataFrame, keys: list[str] = ["fid"]) -> DataFrame:
    """Each (col, row) of a feature once, as statistics count them."""
    return cells.dropDuplicates([*keys, "col", "row"])


def count_by_class(pixels: DataFrame, band: str = "band1", keys: list[str] = ["fid"], nodata=None) -> DataFrame:
    """(keys, class, count) of an integral band; nodata counts as a class unless given."""
    if dict(pixels.dtypes)[band] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("class counts need an integral band")
    p = pixels if nodata is None else pixels.where(F.col(band) != nodata)
    return p.groupBy(*keys, F.col(band).alias("class")).agg(F.count(F.lit(1)).alias("count"))


def extents(cells: DataFrame, keys: list[str] = ["fid"]) -> DataFrame:
    """(keys, min_col, max_col, min_row, max_row) of each feature's cells."""
    return cells.groupBy(*keys).agg(
        F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.min("row").alias("min_row"), F.max("row").alias("max_row")
    )
