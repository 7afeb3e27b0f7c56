"""Rasters and features made from the driver's tables: the inputs of the registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.geom import EPS
from quern.functions.grid import Grid, dbl
from quern.operators.rasterize import box_columns, box_wkt, boxes_to_cells, points_to_cells

SIZE = 64
MAIN = Grid(SIZE, SIZE, 0.0, 64.0, 1.0, -1.0, "dir/main.img", "local")
#: Three overlapping rasters, by return flag.
GRIDS = [Grid(SIZE, SIZE, 16.0 * k, 64.0 + 8.0 * k, 1.0, -1.0, f"dir/{n}.img", "local") for k, n in enumerate("ANR")]
BOX = (2.6, 1.8)
BANDS = ["band1", "band2", "band3"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pixels(lines: DataFrame, *keys: str) -> DataFrame:
    col = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % SIZE).cast("int").alias("col")
    row = ((F.col("l_partkey") * 11 + F.col("l_suppkey")) % SIZE).cast("int").alias("row")
    return lines.groupBy(*keys, col, row).agg(
        F.max(F.floor("l_quantity").cast("int")).alias("band1"), F.min("l_linenumber").cast("int").alias("band2"), F.max("l_extendedprice").alias("band3")
    )


def main_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return _pixels(table(spark, sf, "lineitem"))


def flag_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """(rid, col, row, bands) of the three rasters."""
    p = _pixels(table(spark, sf, "lineitem"), "l_returnflag")
    return p.select(F.concat(F.lit("dir/"), "l_returnflag", F.lit(".img")).alias("rid"), "col", "row", *BANDS)


def points(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: ((F.col("c_custkey") * k) % 7000).cast("double") / dbl(100) - dbl(3)
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), at(37).alias("x"), at(53).alias("y"), "c_mktsegment", "c_nationkey")
    return p.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return box_columns(points(spark, sf), *BOX)


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Line features inside the raster, one segment each."""
    at = lambda a, b: ((F.col("o_orderkey") * a + F.col("o_custkey") * b) % 6200).cast("double") / dbl(100)
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("fid"), (at(3, 17) + dbl(0.5)).alias("x1"), (at(11, 5) + dbl(1.5)).alias("y1"), (at(29, 7) + dbl(0.5)).alias("x2"), (at(13, 23) + dbl(1.5)).alias("y2"))


def point_cells(spark: SparkSession, sf: str) -> DataFrame:
    return points_to_cells(points(spark, sf), MAIN)


def box_cells(spark: SparkSession, sf: str, pixprop: float = 0.5) -> DataFrame:
    return boxes_to_cells(boxes(spark, sf), MAIN, pixprop)


def flag_box_cells(spark: SparkSession, sf: str, pixprop: float = 0.5) -> DataFrame:
    b = boxes(spark, sf)
    return reduce(DataFrame.unionByName, [boxes_to_cells(b, g, pixprop).withColumns({"rid": F.lit(g.rid), "idx": F.lit(k)}) for k, g in enumerate(GRIDS)])


def box_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as a layer of polygons in WKT."""
    return boxes(spark, sf).drop("x", "y").withColumn("wkt", box_wkt())


def wide_size(spark: SparkSession, sf: str) -> int:
    """Columns and rows of the wide raster: they grow with the tables, as its pixels do."""
    return 64 * max(1, int((table(spark, sf, "lineitem").count() / 1500) ** 0.5))


def wide_pixels(spark: SparkSession, sf: str, size: int) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    col, row = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % size, (F.col("l_partkey") * 11 + F.col("l_suppkey") * 3 + F.col("l_orderkey")) % size
    return lines.groupBy(col.cast("int").alias("col"), row.cast("int").alias("row")).agg(F.max(F.floor("l_quantity").cast("int")).alias("band1"))


def wide_boxes(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Boxes of 13 by 9 cells all over the wide raster."""
    at = lambda k: ((F.col("c_custkey") * k) % 7000).cast("double") / dbl(7000) * dbl(size)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), at(37).alias("x"), at(53).alias("y"))
    return box_columns(c.withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")}), 13.0, 9.0)


#: Rasters side by side, eight a row from below; features meet the lower six rows of them.
MANY = [Grid(SIZE, SIZE, 64.0 * (k % 8), 64.0 * (k // 8) + 64.0, 1.0, -1.0, f"dir/t{k}.img", "local", 50.0) for k in range(64)]


def many_pixels(spark: SparkSession, sf: str) -> DataFrame:
    p = _pixels(table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey") % 64), "k")
    return p.select(F.concat(F.lit("dir/t"), F.col("k").cast("string"), F.lit(".img")).alias("rid"), "col", "row", "band1")


def many_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of 13 by 9 cells over the lower rows of those rasters, as WKT."""
    at = lambda k, size: ((F.col("c_custkey") * k) % 7000).cast("double") / dbl(7000) * dbl(size)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), at(37, 512).alias("x"), at(53, 384).alias("y"))
    b = box_columns(c.withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")}), 13.0, 9.0)
    return b.drop("x", "y").withColumn("wkt", box_wkt())


# The same relations for the oracle.

PIX = """SELECT {k} CAST((l_orderkey * 7 + l_linenumber * 13) % 64 AS INTEGER) AS col, CAST((l_partkey * 11 + l_suppkey) % 64 AS INTEGER) AS "row",
  max(CAST(floor(l_quantity) AS INTEGER)) AS band1, CAST(min(l_linenumber) AS INTEGER) AS band2, max(l_extendedprice) AS band3 FROM lineitem GROUP BY ALL"""


def box_cells_sql(g: Grid, p: float = 0.5) -> str:
    a, b, c, d = g.envelope()
    return f"""SELECT k.*, u1 - u0 AS w FROM (SELECT *, (least(u1, CAST(col AS DOUBLE) + CAST(1 AS DOUBLE)) - greatest(u0, CAST(col AS DOUBLE))) * (least(v1, CAST("row" AS DOUBLE) + CAST(1 AS DOUBLE)) - greatest(v0, CAST("row" AS DOUBLE))) AS coverage
  FROM (SELECT *, CAST(unnest(range(CAST(floor(u0) AS BIGINT), CAST(ceil(u1) AS BIGINT))) AS INTEGER) AS col FROM (SELECT *, CAST(unnest(range(CAST(floor(v0) AS BIGINT), CAST(ceil(v1) AS BIGINT))) AS INTEGER) AS "row" FROM (
  SELECT *, (bx0 - CAST({g.x0} AS DOUBLE)) / CAST({g.px} AS DOUBLE) AS u0, (bx1 - CAST({g.x0} AS DOUBLE)) / CAST({g.px} AS DOUBLE) AS u1, (by1 - CAST({g.y0} AS DOUBLE)) / CAST({g.py} AS DOUBLE) AS v0, (by0 - CAST({g.y0} AS DOUBLE)) / CAST({g.py} AS DOUBLE) AS v1
  FROM (SELECT *, greatest(minx, CAST({a} AS DOUBLE)) AS bx0, least(maxx, CAST({c} AS DOUBLE)) AS bx1, greatest(miny, CAST({b} AS DOUBLE)) AS by0, least(maxy, CAST({d} AS DOUBLE)) AS by1 FROM boxes) WHERE bx0 < bx1 AND by0 < by1)))) k
  WHERE coverage >= CAST({p - EPS!r} AS DOUBLE) AND col BETWEEN 0 AND {g.width - 1} AND "row" BETWEEN 0 AND {g.height - 1}"""


CTES = {
    "pix": PIX.format(k=""),
    "pix3": f"SELECT 'dir/' || l_returnflag || '.img' AS rid, * EXCLUDE (l_returnflag) FROM ({PIX.format(k='l_returnflag,')})",
    "pts": """SELECT c_custkey AS fid, CAST((c_custkey * 37) % 7000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(3 AS DOUBLE) AS x,
  CAST((c_custkey * 53) % 7000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(3 AS DOUBLE) AS y, c_mktsegment, c_nationkey FROM customer""",
    "ptcells": """SELECT *, CAST(floor(x) AS INTEGER) AS col, CAST(floor((y - CAST(64 AS DOUBLE)) / CAST(-1 AS DOUBLE)) AS INTEGER) AS "row" FROM pts WHERE x BETWEEN 0 AND 63 AND y BETWEEN 1 AND 64""",
    "boxes": """SELECT fid, x, y, c_mktsegment, c_nationkey, (x + x) / CAST(2 AS DOUBLE) - CAST(1.3 AS DOUBLE) AS minx, (x + x) / CAST(2 AS DOUBLE) + CAST(1.3 AS DOUBLE) AS maxx,
  (y + y) / CAST(2 AS DOUBLE) - CAST(0.9 AS DOUBLE) AS miny, (y + y) / CAST(2 AS DOUBLE) + CAST(0.9 AS DOUBLE) AS maxy FROM pts""",
    "cells": box_cells_sql(MAIN),
    "cells3": " UNION ALL ".join(f"SELECT *, '{g.rid}' AS rid, {k} AS idx FROM ({box_cells_sql(g)})" for k, g in enumerate(GRIDS)),
    "got": "SELECT cells.*, band1, band2, band3 FROM cells JOIN pix USING (col, \"row\")",
    "got3": "SELECT cells3.*, band1, band2, band3 FROM cells3 JOIN pix3 USING (rid, col, \"row\")",
    "rasters": " UNION ALL ".join(
        f"SELECT {k} AS idx, '{g.rid}' AS rid, {g.width} AS width, {g.height} AS height, CAST({g.x0} AS DOUBLE) AS x0, CAST({g.y0} AS DOUBLE) AS y0, CAST({g.px} AS DOUBLE) AS px, CAST({g.py} AS DOUBLE) AS py, '{g.srs}' AS srs, "
        + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in zip(("rminx", "rminy", "rmaxx", "rmaxy"), g.envelope())) for k, g in enumerate(GRIDS)
    ),
    "cands": """SELECT fid, idx, rid, (minx + maxx) / CAST(2 AS DOUBLE) - (rminx + rmaxx) / CAST(2 AS DOUBLE) AS dx, (miny + maxy) / CAST(2 AS DOUBLE) - (rminy + rmaxy) / CAST(2 AS DOUBLE) AS dy
  FROM boxes JOIN rasters ON rminx <= minx AND maxx <= rmaxx AND rminy <= miny AND maxy <= rmaxy""",
    "segs": """SELECT o_orderkey AS fid, CAST((o_orderkey * 3 + o_custkey * 17) % 6200 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS x1, CAST((o_orderkey * 11 + o_custkey * 5) % 6200 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(1.5 AS DOUBLE) AS y1,
  CAST((o_orderkey * 29 + o_custkey * 7) % 6200 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS x2, CAST((o_orderkey * 13 + o_custkey * 23) % 6200 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(1.5 AS DOUBLE) AS y2 FROM orders""",
    "fixed": """SELECT fid, CAST(round_even(256 * (x1 / CAST(1 AS DOUBLE)), 0) AS BIGINT) AS ax, CAST(round_even(256 * ((y1 - 64) / CAST(-1 AS DOUBLE)), 0) AS BIGINT) AS ay,
  CAST(round_even(256 * (x2 / CAST(1 AS DOUBLE)), 0) AS BIGINT) AS bx, CAST(round_even(256 * ((y2 - 64) / CAST(-1 AS DOUBLE)), 0) AS BIGINT) AS by_ FROM segs""",
    "dda": """SELECT *, greatest(abs((bx >> 8) - (ax >> 8)), abs((by_ >> 8) - (ay >> 8))) AS n, abs((bx >> 8) - (ax >> 8)) < abs((by_ >> 8) - (ay >> 8)) AS steep FROM fixed""",
    "linecells": """SELECT fid, CAST(CASE WHEN steep THEN across ELSE along END AS INTEGER) AS col, CAST(CASE WHEN steep THEN along ELSE across END AS INTEGER) AS "row" FROM (
  SELECT fid, steep, k, (CASE WHEN steep THEN ay >> 8 ELSE ax >> 8 END) + k * (CASE WHEN (CASE WHEN steep THEN by_ > ay ELSE bx > ax END) THEN 1 ELSE -1 END) AS along,
    CASE WHEN n = 0 THEN a >> 8 ELSE (a + k * whole + CAST(ceil(CAST((k + 1) * (b - a - whole * n) AS DOUBLE) / n) AS BIGINT) - 1) >> 8 END AS across FROM (
    SELECT *, CAST(ceil(CAST(b - a AS DOUBLE) / greatest(n, 1)) AS BIGINT) - 1 AS whole, unnest(range(n + 1)) AS k FROM (SELECT *, CASE WHEN steep THEN ax ELSE ay END AS a, CASE WHEN steep THEN bx ELSE by_ END AS b FROM dda)))""",
}
NEEDS = {
    "ptcells": ["pts"], "boxes": ["pts"], "cells": ["boxes"], "cells3": ["boxes"], "got": ["cells", "pix"], "got3": ["cells3", "pix3"],
    "cands": ["boxes", "rasters"], "fixed": ["segs"], "dda": ["fixed"], "linecells": ["dda"],
}


def with_(names: str, body: str) -> str:
    """``body`` after the common table expressions it names."""
    order: list[str] = []

    def add(n: str) -> None:
        for k in NEEDS.get(n, []):
            add(k)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + " " + body
