"""Reports and text dumps as relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quern.functions.geom import leaves, parse_wkt, polygon_is_valid, repaired
from quern.functions.grid import Grid, grid_x, grid_y


def vector_report(features: DataFrame, layer: str, kind: str = "kind") -> DataFrame:
    """(layer, geometry, features, minx, miny, maxx, maxy), a row a geometry kind."""
    ends = [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    return features.groupBy(F.col(kind).alias("geometry")).agg(F.count(F.lit(1)).alias("features"), *ends).withColumn("layer", F.lit(layer))


def fields_of(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, position, field, type) of every layer."""
    spark = next(iter(layers.values())).sparkSession
    rows = [(n, k, f.name, f.dataType.simpleString()) for n, df in layers.items() for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "layer string, position int, field string, type string")


def raster_report(rasters: DataFrame) -> DataFrame:
    """(rid, width, height, bands, px, py, corners, srs) of a raster list."""
    at = lambda c, r: F.struct((F.col("x0") + F.col("px") * c).alias("x"), (F.col("y0") + F.col("py") * r).alias("y"))
    w, h = F.col("width"), F.col("height")
    return rasters.select("rid", "width", "height", "bands", "px", "py", at(F.lit(0), F.lit(0)).alias("upper_left"), at(F.lit(0), h).alias("lower_left"), at(w, F.lit(0)).alias("upper_right"), at(w, h).alias("lower_right"), "srs")


def summary(features: DataFrame, cells: DataFrame, kind: str = "kind") -> DataFrame:
    """(counter, value): intersecting features by kind, and processed pixels. ``cells``: (fid, kind, col, row)."""
    hit = cells.select("fid", kind).distinct()
    by = hit.groupBy(F.col(kind).alias("counter")).agg(F.count(F.lit(1)).alias("value"))
    total = hit.agg(F.lit("intersecting").alias("counter"), F.count_distinct("fid").alias("value"))
    pixels = cells.agg(F.lit("pixels").alias("counter"), F.count(F.lit(1)).alias("value"))
    return by.unionByName(total).unionByName(pixels)


VERTEX = StructType([StructField("part", IntegerType()), StructField("label", StringType()), StructField("x", DoubleType()), StructField("y", DoubleType())])


@F.pandas_udf(ArrayType(VERTEX))
def vertex_rows(wkt: pd.Series) -> pd.Series:
    def of(w):
        out = []
        for k, (kind, (part,)) in enumerate(leaves(parse_wkt(w)) if w else ()):
            points = [part] if kind == "POINT" else part if kind == "LINESTRING" else part[0]
            out += [{"part": k, "label": "Point" if kind == "POINT" else "LineString", "x": x, "y": y} for x, y in points]
        return out

    return wkt.map(of)


def dump_vertices(features: DataFrame) -> DataFrame:
    """(fid, part, position, label, line): vertices as plot-tool lines; of polygons the exterior ring."""
    v = features.select("fid", F.posexplode(vertex_rows("wkt")).alias("position", "v"))
    return v.select("fid", "v.part", "position", "v.label", F.format_string("%10.3f , %10.3f", "v.x", "v.y").alias("line"))


COUNTERS = ("invalid", "with interior ring", "exploded", "sub polygons")


def geometry_counters(features: DataFrame) -> DataFrame:
    """(counter, value): features by kind of geometry, and what repair would do with their invalid polygons."""

    @F.pandas_udf("kind string, invalid long, holed long, exploded long, sub long")
    def looked_at(wkt: pd.Series) -> pd.DataFrame:
        rows = []
        for w in wkt:
            g = parse_wkt(w) if w else ("NONE", [])
            bad = [p for k, (p,) in leaves(g) if k == "POLYGON" and not polygon_is_valid(p)]
            pieces = [len(repaired(p)) for p in bad if len(p) == 1]
            rows.append((g[0], len(bad), sum(len(p) > 1 for p in bad), len(pieces), sum(pieces)))
        return pd.DataFrame(rows, columns=["kind", "invalid", "holed", "exploded", "sub"])

    seen = features.select(looked_at("wkt").alias("g")).select("g.*")
    kinds = seen.groupBy(F.col("kind").alias("counter")).agg(F.count(F.lit(1)).alias("value"))
    sums = seen.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("invalid", "holed", "exploded", "sub")))
    pairs = F.array(*(F.struct(F.lit(n).alias("counter"), F.col(c).alias("value")) for n, c in zip(COUNTERS, ("invalid", "holed", "exploded", "sub"))))
    return kinds.unionByName(sums.select(F.explode(pairs).alias("p")).select("p.*"))


@F.pandas_udf(ArrayType(VERTEX))
def ring_rows(wkt: pd.Series) -> pd.Series:
    """Vertices of every ring, those of interior rings too."""

    def of(w):
        out = []
        for k, (kind, (part,)) in enumerate(leaves(parse_wkt(w)) if w else ()):
            lines = [[part]] if kind == "POINT" else [part] if kind == "LINESTRING" else part
            for n, line in enumerate(lines):
                label = "Point" if kind == "POINT" else "LineString" if kind == "LINESTRING" else "Exterior" if n == 0 else "Interior"
                out += [{"part": k, "label": label, "x": x, "y": y} for x, y in line]
        return out

    return wkt.map(of)


def dump_geometries(features: DataFrame, cells: DataFrame, g: Grid, edge_mode: str = "reference") -> DataFrame:
    """(section, fid, part, position, label, line) in order: the grid's ticks, its envelope, vertices of the features, their pixels."""
    spark, at = features.sparkSession, lambda x, y: F.format_string("%10.3f , %10.3f", x, y)
    none = F.lit(-1).cast("long")
    grid = dump_grid(g, spark).select(F.lit(0).alias("section"), none.alias("fid"), F.lit(0).alias("part"), "position", F.col("axis").alias("label"), "line")
    a, b, c, d = g.envelope(edge_mode)
    ends = [(0, a, b), (1, c, b), (2, c, d), (3, a, d), (4, a, b)]
    box = spark.createDataFrame(ends, "position int, x double, y double").select(F.lit(1).alias("section"), none.alias("fid"), F.lit(0).alias("part"), "position", F.lit("Envelope").alias("label"), at("x", "y").alias("line"))
    v = features.select(F.col("fid").cast("long").alias("fid"), F.posexplode(ring_rows("wkt")).alias("position", "v"))
    shapes = v.select(F.lit(2).alias("section"), "fid", "v.part", "position", "v.label", at("v.x", "v.y").alias("line"))
    pixels = cells.select(F.lit(3).alias("section"), F.col("fid").cast("long").alias("fid"), "part", (F.col("row") * g.width + F.col("col")).cast("int").alias("position"), F.lit("Pixel").alias("label"), at(grid_x("col", g), grid_y("row", g)).alias("line"))
    return grid.unionByName(box).unionByName(shapes).unionByName(pixels).orderBy("section", "fid", "part", "position")


def dump_points(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(fid, line) of point features."""
    return points.select("fid", F.format_string("%10.3f , %10.3f", F.col(x).cast("double"), F.col(y).cast("double")).alias("line"))


def dump_grid(g: Grid, spark) -> DataFrame:
    """(axis, position, line): the grid's ticks."""
    lines = lambda n, f, name: spark.range(n + 1).select(F.lit(name).alias("axis"), F.col("id").cast("int").alias("position"), F.format_string("%10.3f", f(F.col("id"), g)).alias("line"))
    return lines(g.width, grid_x, "x").unionByName(lines(g.height, grid_y, "y"))


def intersect_cases(cells: DataFrame, features: DataFrame, g: Grid, share: float | None = None, block: int = 32) -> DataFrame:
    """(fid, block, xml): test cases that each geometry intersects its pixels; features without pixels have none.

    Pixels are points, or squares of ``share`` of a pixel. A case holds those of a square of ``block`` cells,
    so that its text is bounded however large a feature is.
    """
    x, y = grid_x("col", g), grid_y("row", g)
    at = lambda a, b: F.format_string("%.6f %.6f", a, b)
    if share is None:
        one, kind = at(x, y), "MULTIPOINT"
    else:
        x0, y0 = x + F.lit(min(g.px, 0.0)), y + F.lit(min(g.py, 0.0))
        x1, y1 = x0 + F.lit(share * abs(g.px)), y0 + F.lit(share * abs(g.py))
        one, kind = F.concat(F.lit("(("), F.concat_ws(",", at(x0, y0), at(x0, y1), at(x1, y1), at(x1, y0), at(x0, y0)), F.lit("))")), "MULTIPOLYGON"
    own = (F.floor(F.col("row") / block) * F.lit(1 << 16) + F.floor(F.col("col") / block)).cast("int").alias("block")
    body = cells.select("fid", own, "row", "col", one.alias("one")).groupBy("fid", "block").agg(F.sort_array(F.collect_list(F.struct("row", "col", "one"))).alias("b"))
    text = F.concat(F.lit(f"{kind} ("), F.array_join("b.one", ","), F.lit(")"))
    xml = F.concat(F.lit("<case><a>"), F.col("wkt"), F.lit("</a><b>"), text, F.lit('</b><test><op name="intersects" arg1="A" arg2="B">true</op></test></case>'))
    return body.join(features.select("fid", "wkt"), "fid").select("fid", "block", xml.alias("xml"))
