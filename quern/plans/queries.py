"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.geom import EPS
from quern.functions.grid import Grid, centre, closest_col, closest_row
from quern.operators import cutout, extract, legacy, rasterize, report, select, stats
from quern.plans import extraction as x
from quern.session import stored
from quern.sources import fixtures as fx
from quern.sources import tables
from quern.sources.fixtures import BANDS, GRIDS, MAIN, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Result = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Result], Result]:
    def put(f: Result) -> Result:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def under_main(cells: DataFrame, s: SparkSession, sf: str) -> DataFrame:
    """Cells of the main raster with their bands."""
    return extract.join_pixels(cells, fx.main_pixels(s, sf), area=MAIN.area)


def got(s: SparkSession, sf: str) -> DataFrame:
    """Box cells with their bands."""
    return under_main(fx.box_cells(s, sf), s, sf)


def got3(s: SparkSession, sf: str) -> DataFrame:
    return extract.join_pixels(fx.flag_box_cells(s, sf), fx.flag_pixels(s, sf), ("rid", "col", "row"), area=sum(g.area for g in GRIDS))


# statistics


@query(with_("ptcells pix", 'SELECT fid, count(*) AS "numPixels", round(avg(band1), 6) AS avg_band1 FROM ptcells JOIN pix USING (col, "row") GROUP BY fid'))
def zonal_avg_points(s, sf):
    out = stats.zonal_stats(under_main(fx.point_cells(s, sf), s, sf), ["band1"], ["avg"])
    return out.withColumn("avg_band1", F.round("avg_band1", 6))


INT_STATS = list(stats.STATS)


def _int_stats_sql(source: str, nodata: int, compat: bool) -> str:
    out, n = [], f"CASE WHEN band1 <> {nodata} THEN band1 END"
    made = {
        "sum": f"sum(CAST({n} AS DOUBLE))", "min": f"CAST(min({n}) AS DOUBLE)", "max": f"CAST(max({n}) AS DOUBLE)", "avg": f"round(avg({n}), 6)",
        "var": f"round(CASE WHEN count({n}) > 0 THEN coalesce(var_samp({n}), 0) END, 6)", "stdev": f"round(CASE WHEN count({n}) > 0 THEN coalesce(stddev_samp({n}), 0) END, 6)",
        "median": f"median(CAST({n} AS DOUBLE))", "nulls": f"count(*) - count({n})",
    }
    for k in INT_STATS:
        if k == "mode":
            out.append("any_value(m.mode_band1) AS mode_band1")
        elif k == "nulls":
            out.append((f"CASE WHEN count({n}) > 0 THEN count(*) - count({n}) ELSE 0 END" if compat else made[k]) + " AS nulls_band1")
        else:
            out.append((f"coalesce({made[k]}, 0)" if compat else made[k]) + f" AS {k}_band1")
    mode = f"""m AS (SELECT fid, CAST(band1 AS DOUBLE) AS mode_band1 FROM (SELECT fid, band1, row_number() OVER (PARTITION BY fid ORDER BY count(*) DESC, band1) AS k FROM {source} WHERE band1 <> {nodata} GROUP BY fid, band1) WHERE k = 1)"""
    body = f'SELECT s.fid, count(*) AS "numPixels", {", ".join(out)} FROM {source} s LEFT JOIN m ON s.fid = m.fid GROUP BY s.fid'
    if compat:
        body = body.replace("any_value(m.mode_band1)", "coalesce(any_value(m.mode_band1), 0)")
    return mode, body


def _with_mode(names: str, source: str, nodata: int, compat: bool, where: str = "") -> str:
    mode, body = _int_stats_sql(source, nodata, compat)
    return with_(names, "").rstrip() + ", " + mode + " " + body


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith(("avg_", "var_", "stdev_"))})


@query(_with_mode("got", "got", 50, False))
def zonal_stats_int(s, sf):
    return _rounded(stats.zonal_stats(got(s, sf), ["band1"], INT_STATS, nodata=50))


@query(_with_mode("ptcells pix", '(SELECT * FROM ptcells JOIN pix USING (col, "row"))', 50, True))
def zonal_stats_all_nodata_compat(s, sf):
    px = under_main(fx.point_cells(s, sf), s, sf)
    return _rounded(stats.zonal_stats(px, ["band1"], INT_STATS, nodata=50, compat=True))


@query(with_("got", """SELECT s.fid, count(*) AS "numPixels", round(sum(band3), 4) AS sum_band3, min(band3) AS min_band3, max(band3) AS max_band3, any_value(m.v) AS mode_band3, median(band3) AS median_band3 FROM got s
  JOIN (SELECT fid, CAST(key AS DOUBLE) AS v FROM (SELECT fid, printf('%.3f', band3) AS key, row_number() OVER (PARTITION BY fid ORDER BY count(*) DESC, printf('%.3f', band3)) AS k FROM got GROUP BY fid, printf('%.3f', band3)) WHERE k = 1) m ON s.fid = m.fid GROUP BY s.fid"""))
def zonal_stats_float(s, sf):
    out = stats.zonal_stats(got(s, sf), ["band3"], ["sum", "min", "max", "mode", "median"])
    return out.withColumn("sum_band3", F.round("sum_band3", 4))


@query(with_("got", 'SELECT fid, c_mktsegment, count(*) AS "numPixels", round(avg(band1), 6) AS avg_band1, round(avg(band2), 6) AS avg_band2, CAST(max(band1) AS DOUBLE) AS max_band1, CAST(max(band2) AS DOUBLE) AS max_band2 FROM got GROUP BY fid, c_mktsegment'))
def zonal_stats_with_fields(s, sf):
    return _rounded(stats.zonal_stats(got(s, sf), ["band1", "band2"], ["avg", "max"], attrs=["c_mktsegment"]))


@query(with_("got3", 'SELECT fid, rid, count(*) AS "numPixels", CAST(sum(band1) AS DOUBLE) AS sum_band1 FROM got3 GROUP BY fid, rid'))
def zonal_stats_rasters(s, sf):
    return stats.zonal_stats(got3(s, sf), ["band1"], ["sum"], keys=["fid", "rid"])


@query(with_("got", 'SELECT fid, band2 AS class, count(*) AS count FROM got GROUP BY fid, band2'))
def class_counts(s, sf):
    return stats.count_by_class(got(s, sf), "band2")


@query(with_("got", "SELECT fid, count(*) AS \"numPixels\", CAST(max(band1) AS DOUBLE) AS max_band1 FROM got WHERE fid = 7 GROUP BY fid"))
def stats_of_one_feature(s, sf):
    one = extract.by_fid(fx.boxes(s, sf), 7)
    return stats.zonal_stats(under_main(rasterize.boxes_to_cells(one, MAIN), s, sf), ["band1"], ["max"])


@query(with_("got", "SELECT fid, count(*) AS \"numPixels\", CAST(min(band1) AS DOUBLE) AS min_band1 FROM got WHERE fid = (SELECT min(fid) FROM boxes WHERE CAST(c_nationkey AS VARCHAR) = '5') GROUP BY fid"))
def stats_by_field_value(s, sf):
    one = extract.by_field(fx.boxes(s, sf), "c_nationkey", 5)
    return stats.zonal_stats(under_main(rasterize.boxes_to_cells(one, MAIN), s, sf), ["band1"], ["min"])


# pixel tables

TABLE = 'fid AS "FID", c_mktsegment, c_nationkey, \'main.img\' AS "RID", col + 1 AS col, "row" + 1 AS "row", CAST(col AS DOUBLE) AS x, CAST(64 AS DOUBLE) - "row" AS y, band1, band2, band3'


@query(with_("got", f"SELECT {TABLE} FROM got"))
def pixel_table(s, sf):
    return extract.pixel_table(got(s, sf).withColumn("path", F.lit(MAIN.rid)), MAIN, ["c_mktsegment", "c_nationkey"], BANDS)


@query(with_("got", 'SELECT fid AS "FID", c_nationkey, band1 FROM got'))
def pixel_table_fields(s, sf):
    attrs = extract.select_fields(fx.points(s, sf).drop("x", "y"), ["c_nationkey"])
    return extract.pixel_table(got(s, sf), MAIN, attrs, ["band1"], rid="none", col_row=False, xy=False)


@query(with_("got3", 'SELECT fid AS "FID", regexp_replace(rid, \'^.*[/:\\\\]\', \'\') AS "RID", col + 1 AS col, "row" + 1 AS "row", band1, band2, band3 FROM got3'))
def pixel_table_rasters(s, sf):
    return extract.pixel_table(got3(s, sf), MAIN, [], BANDS, path="rid", xy=False)


@query(with_("got", "SELECT fid, c_mktsegment, col, \"row\", band1 FROM got WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10"))
def where_filter(s, sf):
    f = fx.boxes(s, sf).where("c_mktsegment = 'BUILDING' and c_nationkey < 10")
    return under_main(rasterize.boxes_to_cells(f, MAIN), s, sf).select("fid", "c_mktsegment", "col", "row", "band1")


@query(with_("ptcells pix", "SELECT fid, n_name, band1 FROM ptcells JOIN nation ON c_nationkey = n_nationkey JOIN pix USING (col, \"row\") WHERE n_regionkey = 1"))
def sql_layer(s, sf):
    layer = tables.sql_layer(
        s, "SELECT p.*, n_name FROM quern_points p JOIN quern_nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
        quern_points=fx.points(s, sf), quern_nation=fx.table(s, sf, "nation"),
    )
    return under_main(rasterize.points_to_cells(layer, MAIN), s, sf).select("fid", "n_name", "band1")


@query(with_("cells pix", 'SELECT c.fid, c.col, c."row", coalesce(b.band1, 0) AS value FROM cells c LEFT JOIN (SELECT * FROM pix WHERE band1 > 45) b USING (col, "row")'))
def band_values(s, sf):
    thin = fx.main_pixels(s, sf).where("band1 > 45")
    return extract.band_values(fx.box_cells(s, sf), thin, "band1").select("fid", "col", "row", "value")


@query(with_("pts pix", 'SELECT fid, band1, band3 FROM (SELECT *, CAST(floor(x) AS INTEGER) AS col, CAST(floor(64 - y) AS INTEGER) AS "row" FROM pts) LEFT JOIN pix USING (col, "row")'))
def pixel_lookup(s, sf):
    from quern.functions.grid import col_of, row_of

    cells = fx.points(s, sf).withColumn("col", col_of("x", MAIN)).withColumn("row", row_of("y", MAIN))
    return extract.join_pixels(cells, fx.main_pixels(s, sf), how="left", area=MAIN.area).select("fid", "band1", "band3")


@query(with_("pix", 'SELECT a.col, a."row", a.band1, b.band2 AS band2, b.band3 AS band3 FROM pix a JOIN pix b USING (col, "row")'))
def stack_bands(s, sf):
    p = fx.main_pixels(s, sf)
    return extract.stack(p.select("col", "row", "band1"), p.select("col", "row", "band2", "band3"), MAIN, MAIN)


@query(with_("pts", "SELECT fid, CAST(CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END AS INTEGER) AS col, CAST(CASE WHEN 64 - y < 0 THEN -floor(y - 64 + 0.5) ELSE floor(64 - y + 0.5) END AS INTEGER) AS \"row\" FROM pts"))
def closest_cells(s, sf):
    return fx.points(s, sf).select("fid", closest_col("x", MAIN).alias("col"), closest_row("y", MAIN).alias("row"))


# filters and checks


@query(with_("boxes", "SELECT fid FROM boxes WHERE maxx >= 0 AND minx <= 63 AND maxy >= 1 AND miny <= 64"))
def spatial_filter(s, sf):
    return extract.touching(fx.boxes(s, sf), MAIN).select("fid")


@query(with_("boxes rasters", "SELECT fid FROM boxes b WHERE EXISTS (SELECT 1 FROM rasters WHERE maxx >= rminx AND minx <= rmaxx AND maxy >= rminy AND miny <= rmaxy)"))
def spatial_filter_any(s, sf):
    return extract.touching_any(fx.boxes(s, sf), tables.raster_list(s, GRIDS, 3)).select("fid")


ODD = Grid(64, 64, 0.0, 64.0, 2.0, -2.0, "dir/odd.img", "other")
CHECKED = "FROM (SELECT srs, px, py FROM rasters UNION ALL SELECT 'other', CAST(2 AS DOUBLE), CAST(-2 AS DOUBLE))"


@query(with_("rasters", f"""SELECT 'same' AS run, count(DISTINCT srs) = 1 AND min(srs) = 'local' AS same_srs, count(DISTINCT (px, py)) = 1 AS same_pixel_size, count(DISTINCT srs) = 1 AND min(srs) = 'local' AND count(DISTINCT (px, py)) = 1 AS ok FROM rasters
  UNION ALL SELECT 'odd', count(DISTINCT srs) = 1 AND min(srs) = 'local', count(DISTINCT (px, py)) = 1, count(DISTINCT srs) = 1 AND min(srs) = 'local' AND count(DISTINCT (px, py)) = 1 {CHECKED}
  UNION ALL SELECT 'vector', count(DISTINCT srs) = 1 AND min(srs) = 'elsewhere', count(DISTINCT (px, py)) = 1, false FROM rasters"""))
def validate_inputs(s, sf):
    runs = {"same": (GRIDS, "local"), "odd": ([*GRIDS, ODD], "local"), "vector": (GRIDS, "elsewhere")}
    return reduce(DataFrame.unionByName, (extract.validate_inputs(tables.raster_list(s, g, 3), srs).select(F.lit(n).alias("run"), "*") for n, (g, srs) in runs.items()))


@query(with_("boxes", "SELECT fid, (minx + maxx) / CAST(2 AS DOUBLE) AS cx, (miny + maxy) / CAST(2 AS DOUBLE) AS cy FROM boxes WHERE fid % 3 <> 0"))
def skip_fids(s, sf):
    skipped = fx.points(s, sf).where("fid % 3 = 0")
    cx, cy = centre()
    return extract.without_fids(fx.boxes(s, sf), skipped).select("fid", cx.alias("cx"), cy.alias("cy"))


# choice of rasters


@query(with_("cands", """SELECT fid, idx, rid FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY CASE WHEN n > 1 THEN d ELSE 0 END, idx) AS k FROM
  (SELECT *, sqrt(dx * dx + dy * dy) AS d, count(*) OVER (PARTITION BY fid) AS n FROM cands)) WHERE k = 1"""))
def select_distance(s, sf):
    return select.choose(select.candidates(fx.boxes(s, sf), tables.raster_list(s, GRIDS, 3)), [("distance",)])


@query(with_("cands", """, a AS (SELECT *, count(*) OVER (PARTITION BY fid) AS n, CASE WHEN sqrt(dx * dx + dy * dy) <= 1e-4 THEN 0 ELSE abs(atan2(dy, dx) * CAST(180 AS DOUBLE) / CAST(3.14159265 AS DOUBLE) - 45) END AS s1 FROM cands),
  b AS (SELECT *, CASE WHEN n > 1 THEN s1 ELSE 0 END AS sc FROM a), c AS (SELECT * FROM (SELECT *, min(sc) OVER (PARTITION BY fid) AS best FROM b) WHERE n = 1 OR sc <= best + 5),
  d AS (SELECT *, count(*) OVER (PARTITION BY fid) AS n2 FROM c), e AS (SELECT *, CASE WHEN n2 > 1 THEN sqrt(dx * dx + dy * dy) ELSE sc END AS sc2 FROM d)
  SELECT fid, idx, rid FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY sc2, idx) AS k FROM (SELECT *, min(sc2) OVER (PARTITION BY fid) AS best2 FROM e) WHERE n2 = 1 OR sc2 <= best2 * 6) WHERE k = 1""").replace(") , a AS", "), a AS"))
def select_direction_then_distance(s, sf):
    return select.choose(select.candidates(fx.boxes(s, sf), tables.raster_list(s, GRIDS, 3)), [("direction", 45), ("distance",)])


def _screened(s, sf, px):
    c = select.candidates(fx.boxes(s, sf), tables.raster_list(s, GRIDS, 3))
    c = select.screen_nodata(c, px, ["band1", "band2"], 50, "band 1")
    # the mask of a raster: 0 where its second band is 7
    return select.screen_masks(c, px.withColumn("mask", F.when(F.col("band2") == 7, 0).otherwise(1)), ["mask"])


SCREEN = """, good AS (SELECT * FROM cands c WHERE NOT EXISTS (SELECT 1 FROM got3 g WHERE g.fid = c.fid AND g.rid = c.rid AND (abs(band1 - 50) <= 1e-3 OR band2 = 7))),
  best AS (SELECT fid, idx, rid FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY CASE WHEN n > 1 THEN d ELSE 0 END, idx) AS k FROM (SELECT *, sqrt(dx * dx + dy * dy) AS d, count(*) OVER (PARTITION BY fid) AS n FROM good)) WHERE k = 1)"""


@query(with_("cands got3", SCREEN + " SELECT * FROM best").replace(") , good", "), good"))
def select_screened(s, sf):
    return select.choose(_screened(s, sf, got3(s, sf)), [("distance",)])


@query(with_("cands got3", SCREEN + ' SELECT g.fid, g.rid, col, "row", band1 FROM got3 g JOIN best USING (fid, rid)').replace(") , good", "), good"))
def duplicate_pixel_table(s, sf):
    px = stored(got3(s, sf).select("fid", "rid", "col", "row", "band1", "band2"), "cells")
    best = select.choose(_screened(s, sf, px), [("distance",)]).select("fid", "rid")
    return px.join(best, ["fid", "rid"], "left_semi").select("fid", "rid", "col", "row", "band1")


# lines, polygons, burning


@query(with_("linecells", 'SELECT fid, col, "row" FROM linecells WHERE col BETWEEN 0 AND 63 AND "row" BETWEEN 0 AND 63'))
def line_cells(s, sf):
    return rasterize.segments_to_cells(fx.segments(s, sf), MAIN).select("fid", "col", "row")


@query(with_("linecells pix", 'SELECT fid, count(*) AS "numPixels", CAST(sum(band1) AS DOUBLE) AS sum_band1 FROM (SELECT DISTINCT fid, col, "row" FROM linecells) JOIN pix USING (col, "row") GROUP BY fid'))
def line_stats(s, sf):
    cells = rasterize.segments_to_distinct_cells(fx.segments(s, sf), MAIN)
    return stats.zonal_stats(under_main(cells, s, sf), ["band1"], ["sum"])


def triangles(s, sf):
    """Polygon features as WKT."""
    b = fx.boxes(s, sf)
    at = lambda x, y: F.concat_ws(" ", x, y)
    ring = F.concat_ws(",", at("minx", "miny"), at("maxx", "miny"), at("minx", "maxy"), at("minx", "miny"))
    return b.withColumn("wkt", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))


def _rectangles(source: str, columns: str, bounds: tuple[str, str, str, str]) -> str:
    """Cells of the main raster under bounds, as rectangles (a, b) to (c, d) cut by bounds and envelope."""
    e, (x0, y0, x1, y1) = MAIN.envelope(), bounds
    return f"""(SELECT *, greatest(CAST(col AS DOUBLE), {x0}, {e[0]}) AS a, least(CAST(col + 1 AS DOUBLE), {x1}, {e[2]}) AS c, greatest(CAST(63 - "row" AS DOUBLE), {y0}, {e[1]}) AS b, least(CAST(64 - "row" AS DOUBLE), {y1}, {e[3]}) AS d
  FROM (SELECT {columns}, col, CAST(unnest(range(greatest(0, CAST(floor(64 - {y1}) AS BIGINT)), least(64, CAST(ceil(64 - {y0}) AS BIGINT)))) AS INTEGER) AS "row" FROM (SELECT *, CAST(unnest(range(greatest(0, CAST(floor({x0}) AS BIGINT)), least(64, CAST(ceil({x1}) AS BIGINT)))) AS INTEGER) AS col FROM {source})))"""


def _below(u: str, v: str, d: str) -> str:
    """Area of u' >= u, v' >= v, u' + v' <= d."""
    return f"power(greatest(0, {d} - ({u}) - ({v})), 2) / 2"


def _corner(u0: str, u1: str, v0: str, v1: str, d: str) -> str:
    """Area of a rectangle below the diagonal u + v = d, all of its sides at 0 or above."""
    return f"(CASE WHEN {u1} > {u0} AND {v1} > {v0} THEN {_below(u0, v0, d)} - {_below(u1, v0, d)} - {_below(u0, v1, d)} + {_below(u1, v1, d)} ELSE 0 END)"


LEGS = ("(maxx - minx)", "(maxy - miny)")
TRIANGLE = f"{LEGS[0]} * {LEGS[1]} * " + _corner(f"((a - minx) / {LEGS[0]})", f"((c - minx) / {LEGS[0]})", f"((b - miny) / {LEGS[1]})", f"((d - miny) / {LEGS[1]})", "1")


@query(with_("boxes", f"""SELECT fid, 0 AS part, 'POLYGON' AS kind, col, "row" FROM {_rectangles("boxes", "fid, minx, miny, maxx, maxy", ("minx", "miny", "maxx", "maxy"))} WHERE c > a AND d > b AND {TRIANGLE} >= {0.4 - EPS!r}"""))
def polygon_cells(s, sf):
    return rasterize.geometries_to_cells(triangles(s, sf), MAIN, 0.4)


@query(with_("cells", 'SELECT fid, col, "row" FROM cells'))
def polygon_cells_of_boxes(s, sf):
    f = fx.boxes(s, sf).withColumn("wkt", rasterize.box_wkt())
    return rasterize.geometries_to_cells(f, MAIN, 0.5).select("fid", "col", "row")


@query(with_("linecells", 'SELECT DISTINCT fid, col, "row" FROM linecells WHERE col BETWEEN 0 AND 63 AND "row" BETWEEN 0 AND 63'))
def wkt_line_cells(s, sf):
    at = lambda x, y: F.concat_ws(" ", x, y)
    f = fx.segments(s, sf).withColumn("wkt", F.concat(F.lit("LINESTRING ("), at("x1", "y1"), F.lit(","), at("x2", "y2"), F.lit(")")))
    return rasterize.geometries_to_cells(f, MAIN).select("fid", "col", "row")


def _diamond(d: float) -> str:
    """Area of a rectangle within ``d`` of (x, y) by the sum of the distances along the axes: a disc of four vertices."""
    sides = (("(a - x)", "(c - x)"), ("(x - c)", "(x - a)")), (("(b - y)", "(d - y)"), ("(y - d)", "(y - b)"))
    return " + ".join(_corner(f"greatest(0, {u0})", f"greatest(0, {u1})", f"greatest(0, {v0})", f"greatest(0, {v1})", str(d)) for u0, u1 in sides[0] for v0, v1 in sides[1])


BUFFERED = f"""SELECT fid, col, "row" FROM {_rectangles("pts", "fid, x, y", ("(x - 3)", "(y - 3)", "(x + 3)", "(y + 3)"))} WHERE c > a AND d > b AND {_diamond(3)} >= {0.5 - EPS!r}"""


@query(with_("pts", BUFFERED))
def buffered_points(s, sf):
    return rasterize.geometries_to_cells(rasterize.buffer_wkt(point_layer(s, sf), 3), MAIN).select("fid", "col", "row")


def point_layer(s, sf):
    """Points as a layer in WKT."""
    return fx.points(s, sf).withColumn("wkt", F.concat_ws("", F.lit("POINT ("), F.concat_ws(" ", "x", "y"), F.lit(")")))


@query(with_("cells", 'SELECT c AS col, r AS "row", CAST(CASE WHEN k.col IS NULL THEN 0 ELSE 1 END AS SMALLINT) AS value FROM (SELECT CAST(range AS INTEGER) AS c FROM range(64)) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS r FROM range(64)) b LEFT JOIN (SELECT DISTINCT col, "row" FROM cells) k ON k.col = c AND k."row" = r'))
def burned_raster(s, sf):
    return cutout.burn(fx.box_cells(s, sf), MAIN)


# cut-outs and strips

WINDOWS = """, e AS (SELECT fid, min(col) AS col0, max(col) AS c1, min("row") AS row0, max("row") AS r1 FROM cells GROUP BY fid),
  win AS (SELECT fid, printf('cut_%04d.img', fid) AS name, col0, row0, c1 - col0 + 1 AS width, r1 - row0 + 1 AS height, CAST(col0 AS DOUBLE) AS ulx, CAST(64 AS DOUBLE) - row0 AS uly FROM e)"""


def _win(body: str, names: str = "cells") -> str:
    return with_(names, WINDOWS + " " + body).replace(") , e AS", "), e AS")


@query(_win("SELECT * FROM win"))
def cutout_windows(s, sf):
    return cutout.cutout_windows(fx.box_cells(s, sf), MAIN, "cut_")


@query(_win("SELECT fid, name, col0, row0, width + width % 2 AS width, height + height % 2 AS height, ulx, uly FROM win"))
def cutout_windows_even(s, sf):
    return cutout.cutout_windows(fx.box_cells(s, sf), MAIN, "cut_", parity="even")


CUT = """, a AS (SELECT *, CAST(unnest(range(height)) AS INTEGER) AS r FROM win), b AS (SELECT *, CAST(unnest(range(width)) AS INTEGER) AS c FROM a), w AS (SELECT fid, col0 + c AS col, row0 + r AS "row", c, r FROM b)"""


@query(_win(CUT + ' SELECT w.fid, c, r, coalesce(band1, -1) AS band1 FROM w LEFT JOIN pix USING (col, "row")', "cells pix"))
def cutouts(s, sf):
    return cutout.cutouts(fx.box_cells(s, sf), fx.main_pixels(s, sf), MAIN, ["band1"], nodata=-1)


@query(_win(CUT + ' SELECT w.fid, c, r, CASE WHEN k.fid IS NULL THEN -1 ELSE coalesce(band1, -1) END AS band1 FROM w LEFT JOIN pix USING (col, "row") LEFT JOIN (SELECT DISTINCT fid, col, "row" FROM cells) k ON k.fid = w.fid AND k.col = w.col AND k."row" = w."row"', "cells pix"))
def cutouts_inside(s, sf):
    return cutout.cutouts(fx.box_cells(s, sf), fx.main_pixels(s, sf), MAIN, ["band1"], only_inside=True, nodata=-1)


LAYOUT = ", lay AS (SELECT *, CAST(coalesce(sum(height + 2) OVER (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS strip_row FROM win)"


def _layout(s, sf):
    return cutout.strip_layout(cutout.cutout_windows(fx.box_cells(s, sf), MAIN, "cut_"), separation=2)


@query(_win(LAYOUT + " SELECT * FROM lay"))
def strip_layout(s, sf):
    return _layout(s, sf)


@query(_win(LAYOUT + " SELECT max(width) AS strip_width, max(strip_row + height) AS strip_height FROM lay"))
def strip_size(s, sf):
    return cutout.strip_size(_layout(s, sf))


STRIP = LAYOUT + CUT + """, cov AS (SELECT c AS strip_col, strip_row + r AS strip_row, coalesce(band1, 0) AS band1, w.fid, CAST(w.col AS FLOAT) AS x, CAST(64 - w."row" AS FLOAT) AS y FROM w JOIN lay USING (fid) LEFT JOIN pix ON pix.col = w.col AND pix."row" = w."row")"""


@query(_win(STRIP + " SELECT * FROM cov", "cells pix"))
def strip_pixels(s, sf):
    return cutout.strip_pixels(_layout(s, sf), fx.main_pixels(s, sf), MAIN, ["band1"])


@query(_win(STRIP + """, size AS (SELECT max(width) AS sw, max(strip_row + height) AS sh FROM lay), rows_ AS (SELECT sw, CAST(unnest(range(sh)) AS BIGINT) AS strip_row FROM size), grid AS (SELECT strip_row, CAST(unnest(range(sw)) AS INTEGER) AS strip_col FROM rows_)
  SELECT strip_col, strip_row, coalesce(band1, 0) AS band1, coalesce(fid, -1) AS fid, coalesce(x, CAST(0 AS FLOAT)) AS x, coalesce(y, CAST(0 AS FLOAT)) AS y FROM grid LEFT JOIN cov USING (strip_col, strip_row)""", "cells pix"))
def strip_full(s, sf):
    lay = _layout(s, sf)
    return cutout.strip_full(lay, cutout.strip_pixels(lay, fx.main_pixels(s, sf), MAIN, ["band1"]), ["band1"])


@query(_win(LAYOUT + """, mv AS (SELECT b.fid, (minx - ulx) - minx AS dx, (maxy - uly) + strip_row * CAST(-1 AS DOUBLE) - maxy AS dy, minx, miny, maxx, maxy FROM boxes b JOIN lay USING (fid))
  SELECT fid, round(dx, 6) AS dx, round(dy, 6) AS dy, round(minx + dx, 6) AS minx, round(miny + dy, 6) AS miny, round(maxx + dx, 6) AS maxx, round(maxy + dy, 6) AS maxy FROM mv""", "cells boxes"))
def strip_vector(s, sf):
    out = cutout.strip_vector(fx.boxes(s, sf), _layout(s, sf), MAIN)
    return out.select("fid", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(with_("pix", 'SELECT col - 8 AS col, "row" - 4 AS "row", band1 FROM pix WHERE col BETWEEN 8 AND 39 AND "row" BETWEEN 4 AND 19'))
def cropped_raster(s, sf):
    return cutout.crop(fx.main_pixels(s, sf), 8, 4, 32, 16, MAIN)[0].select("col", "row", "band1")


# reports


@query(with_("boxes", "SELECT 'boxes' AS layer, 'POLYGON' AS geometry, count(*) AS features, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM boxes"))
def vector_report(s, sf):
    return report.vector_report(fx.boxes(s, sf).withColumn("kind", F.lit("POLYGON")), "boxes")


@query("SELECT rid, width, height, 3 AS bands, px, py, x0 AS ulx, y0 AS uly, x0 + px * width AS lrx, y0 + py * height AS lry, srs FROM (" + fx.CTES["rasters"] + ")")
def raster_report(s, sf):
    r = report.raster_report(tables.raster_list(s, GRIDS, 3))
    return r.select("rid", "width", "height", "bands", "px", "py", F.col("upper_left.x").alias("ulx"), F.col("upper_left.y").alias("uly"), F.col("lower_right.x").alias("lrx"), F.col("lower_right.y").alias("lry"), "srs")


@query("SELECT * FROM (VALUES ('points', 0, 'fid', 'bigint'), ('points', 1, 'x', 'double'), ('points', 2, 'y', 'double'), ('points', 3, 'c_mktsegment', 'string'), ('points', 4, 'c_nationkey', 'int')) t(layer, position, field, type)")
def show_fields(s, sf):
    return report.fields_of({"points": fx.points(s, sf).drop("minx", "miny", "maxx", "maxy")})


@query(with_("cells linecells", """, a AS (SELECT fid, 'POLYGON' AS kind, col, "row" FROM cells UNION ALL SELECT -fid, 'LINESTRING', col, "row" FROM linecells WHERE col BETWEEN 0 AND 63 AND "row" BETWEEN 0 AND 63)
  SELECT kind AS counter, count(DISTINCT fid) AS value FROM a GROUP BY kind UNION ALL SELECT 'intersecting', count(DISTINCT fid) FROM a UNION ALL SELECT 'pixels', count(*) FROM a""").replace(") , a AS", "), a AS"))
def traversal_summary(s, sf):
    cells = fx.box_cells(s, sf).select("fid", F.lit("POLYGON").alias("kind"), "col", "row")
    lines = rasterize.segments_to_cells(fx.segments(s, sf), MAIN).select((-F.col("fid")).alias("fid"), F.lit("LINESTRING").alias("kind"), "col", "row")
    return report.summary(None, cells.unionByName(lines))


@query(with_("pts", "SELECT fid, printf('%10.3f , %10.3f', x, y) AS line FROM pts"))
def dump_points(s, sf):
    return report.dump_points(fx.points(s, sf))


@query(with_("segs", "SELECT fid, 0 AS part, 0 AS position, 'LineString' AS label, printf('%10.3f , %10.3f', x1, y1) AS line FROM segs UNION ALL SELECT fid, 0, 1, 'LineString', printf('%10.3f , %10.3f', x2, y2) FROM segs"))
def dump_vertices(s, sf):
    at = lambda x, y: F.concat_ws(" ", x, y)
    return report.dump_vertices(fx.segments(s, sf).withColumn("wkt", F.concat(F.lit("LINESTRING ("), at("x1", "y1"), F.lit(","), at("x2", "y2"), F.lit(")"))))


@query("SELECT 'x' AS axis, CAST(range AS INTEGER) AS position, printf('%10.3f', CAST(range AS DOUBLE)) AS line FROM range(65) UNION ALL SELECT 'y', CAST(range AS INTEGER), printf('%10.3f', CAST(64 - range AS DOUBLE)) FROM range(65)")
def dump_grid(s, sf):
    return report.dump_grid(MAIN, s)


@query(with_("cells", """, one AS (SELECT fid, "row" // 32 * 65536 + col // 32 AS block, "row", col, printf('%.6f %.6f', CAST(col AS DOUBLE), CAST(64 - "row" AS DOUBLE)) AS p FROM cells)
  SELECT fid, CAST(block AS INTEGER) AS block, '<case><a>' || any_value(printf('feature %d', fid)) || '</a><b>MULTIPOINT (' || string_agg(p, ',' ORDER BY "row", col) || ')</b><test><op name="intersects" arg1="A" arg2="B">true</op></test></case>' AS xml FROM one GROUP BY fid, block""").replace(") , one AS", "), one AS"))
def intersect_cases(s, sf):
    f = fx.boxes(s, sf).withColumn("wkt", F.concat(F.lit("feature "), F.col("fid").cast("string")))  # the text of a geometry is copied as it is
    return report.intersect_cases(fx.box_cells(s, sf), f, MAIN)


# runs of the plan builder: what the command line does, over layers in WKT and several rasters


def flags(s, sf, nodata=None) -> x.Rasters:
    grids = [replace(g, nodata=nodata) for g in GRIDS]
    return x.Rasters(tables.raster_list(s, grids, 3), fx.flag_pixels(s, sf))


def main(s, sf) -> list:
    return [(MAIN, fx.main_pixels(s, sf))]


PLACED = "got3 JOIN (SELECT rid, x0, y0, px, py FROM rasters) USING (rid)"
SHORT = "regexp_replace(rid, '^.*[/:\\\\]', '')"


@query(with_("got3 rasters", f"""SELECT fid AS "FID", c_mktsegment, {SHORT} AS "RID", col + 1 AS col, "row" + 1 AS "row", x0 + col * px AS x, y0 + "row" * py AS y, band1, band2, band3 FROM {PLACED}"""))
def run_table(s, sf):
    return x.table(fx.box_layer(s, sf), flags(s, sf), x.Options(fields=["c_mktsegment"]))


def _run_stats_sql(nodata: int) -> str:
    """Statistics by feature and raster: the key of the helper is both."""
    mode, body = _int_stats_sql("k", nodata, False)
    both = "k AS (SELECT fid * 3 + idx AS fid, band1, c_nationkey FROM got3)"
    names = "split AS (SELECT fid AS key, fid // 3 AS fid, list_extract(['dir/A.img', 'dir/N.img', 'dir/R.img'], CAST(fid % 3 + 1 AS INTEGER)) AS rid FROM k)"
    out = f"SELECT DISTINCT split.fid, c_nationkey, rid, b.* EXCLUDE (fid) FROM b JOIN split ON key = b.fid JOIN boxes ON boxes.fid = split.fid"
    return with_("got3 boxes", "").rstrip() + f", {both}, {names}, {mode}, b AS ({body}) {out}"


@query(_run_stats_sql(50))
def run_statistics(s, sf):
    """Each raster's own nodata is left out."""
    return _rounded(x.statistics(fx.box_layer(s, sf), flags(s, sf, 50.0).of_bands("band1"), x.Options(fields=["c_nationkey"], stats=INT_STATS)))


@query(with_("got", 'SELECT fid, \'dir/main.img\' AS rid, count(*) AS "numPixels", CAST(min(band1) AS DOUBLE) AS min_band1, CAST(min(band2) AS DOUBLE) AS min_band2, min(band3) AS min_band3, count(*) - count(*) FILTER (band1 <> 0) AS nulls_band1, count(*) - count(*) FILTER (band2 <> 0) AS nulls_band2, count(*) - count(*) FILTER (band3 <> 0) AS nulls_band3 FROM got GROUP BY fid'))
def run_statistics_given_nodata(s, sf):
    """A given value wins over the raster's, 0 too."""
    r = [(replace(MAIN, nodata=1.0), fx.main_pixels(s, sf))]
    return x.statistics(fx.box_layer(s, sf), r, x.Options(fields="none", stats=["min", "nulls"], nodata=0.0))


@query(with_("got3", "SELECT fid, rid, band2 AS class, count(*) AS count FROM got3 GROUP BY fid, rid, band2"))
def run_classes(s, sf):
    return x.classes(fx.box_layer(s, sf), flags(s, sf), band="band2")


@query(with_("got3 cands", SCREEN + f""" SELECT g.fid AS "FID", {SHORT} AS "RID", col + 1 AS col, "row" + 1 AS "row", band1 FROM got3 g JOIN best USING (fid, rid)""").replace(") , good", "), good"))
def run_duplicates(s, sf):
    """Nodata of the first band and masks screen the rasters; the nearest of the rest gives the pixels."""
    px = fx.flag_pixels(s, sf)
    masks = [(g, px.where(F.col("rid") == g.rid).select("col", "row", F.when(F.col("band2") == 7, 0).otherwise(1).alias("band1"))) for g in GRIDS]
    o = x.Options(fields="none", xy=False, duplicate=[("distance",)], ignore_nodata="band 1")
    return x.table(fx.box_layer(s, sf), x.Rasters(tables.raster_list(s, [replace(g, nodata=50.0) for g in GRIDS], 3), px.select("rid", "col", "row", "band1")), o, masks)


@query(with_("pts pix", f"""SELECT fid, 'dir/main.img' AS rid, count(*) AS "numPixels", CAST(sum(band1) AS DOUBLE) AS sum_band1 FROM ({BUFFERED}) JOIN pix USING (col, "row") WHERE fid IN (SELECT fid FROM pts WHERE x BETWEEN 0 AND 63 AND y BETWEEN 1 AND 64) GROUP BY fid"""))
def run_buffers(s, sf):
    """Buffers are tested against rasters that the features themselves meet."""
    r = [(MAIN, fx.main_pixels(s, sf).select("col", "row", "band1"))]
    return x.statistics(point_layer(s, sf), r, x.Options(fields="none", buffer=(3,), stats=["sum"]))


@query(_win("SELECT fid, 'dir/main.img' AS rid, name, col0, row0, width + width % 2 AS width, height + height % 2 AS height, ulx, uly FROM win"))
def run_windows(s, sf):
    return x.mini_rasters(fx.box_layer(s, sf), main(s, sf), x.Options(parity="even"), "cut_")[0]


@query(_win(CUT + """ SELECT w.fid, 'dir/main.img' AS rid, c, r, CASE WHEN k.fid IS NULL THEN -7 ELSE coalesce(band1, -7) END AS band1, CASE WHEN k.fid IS NULL THEN -7 ELSE coalesce(band3, -7) END AS band2, CASE WHEN k.fid IS NULL THEN -7 ELSE coalesce(band2, -7) END AS band3
  FROM w LEFT JOIN pix USING (col, "row") LEFT JOIN (SELECT DISTINCT fid, col, "row" FROM cells) k ON k.fid = w.fid AND k.col = w.col AND k."row" = w."row\"""", "cells pix"))
def run_mini_rasters(s, sf):
    """Two rasters of one grid add their bands up; what is outside a feature reads the raster's own nodata."""
    px = fx.main_pixels(s, sf)
    g = replace(MAIN, nodata=-7.0)
    return x.mini_rasters(fx.box_layer(s, sf), [(g, px.select("col", "row", "band1", F.col("band3").alias("band2"))), (replace(g, rid="dir/second.img"), px.select("col", "row", F.col("band2").alias("band1")))], x.Options(only_inside=True))[1]


CHOSEN = """, best AS (SELECT fid, idx, rid FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY CASE WHEN n > 1 THEN d ELSE 0 END, idx) AS k FROM (SELECT *, sqrt(dx * dx + dy * dy) AS d, count(*) OVER (PARTITION BY fid) AS n FROM cands)) WHERE k = 1),
  own AS (SELECT fid, rid, col, "row" FROM cells3 JOIN best USING (fid, rid)), e AS (SELECT fid, rid, min(col) AS col0, max(col) - min(col) + 1 AS width, min("row") AS row0, max("row") - min("row") + 1 AS height FROM own GROUP BY fid, rid),
  lay AS (SELECT *, CAST(coalesce(sum(height + 1) OVER (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS strip_row FROM e),
  a1 AS (SELECT *, CAST(unnest(range(height)) AS INTEGER) AS r FROM lay), b1 AS (SELECT *, CAST(unnest(range(width)) AS INTEGER) AS c FROM a1), w AS (SELECT fid, rid, col0 + c AS col, row0 + r AS "row", c, strip_row + r AS strip_row FROM b1),
  cov AS (SELECT w.c AS strip_col, w.strip_row, CASE WHEN k.fid IS NULL THEN 0 ELSE coalesce(band1, 0) END AS band1, w.fid, CAST(x0 + w.col * px AS FLOAT) AS x, CAST(y0 + w."row" * py AS FLOAT) AS y FROM w JOIN rasters USING (rid)
    LEFT JOIN pix3 ON pix3.rid = w.rid AND pix3.col = w.col AND pix3."row" = w."row" LEFT JOIN own k ON k.fid = w.fid AND k.col = w.col AND k."row" = w."row"),
  size AS (SELECT max(width) AS sw, max(strip_row + height) AS sh FROM lay), rows_ AS (SELECT sw, CAST(unnest(range(sh)) AS BIGINT) AS strip_row FROM size), grid AS (SELECT strip_row, CAST(unnest(range(sw)) AS INTEGER) AS strip_col FROM rows_)
  SELECT strip_col, strip_row, coalesce(band1, 0) AS band1, coalesce(fid, -1) AS fid, coalesce(x, CAST(0 AS FLOAT)) AS x, coalesce(y, CAST(0 AS FLOAT)) AS y FROM grid LEFT JOIN cov USING (strip_col, strip_row)"""


@query(with_("cands cells3 rasters pix3", CHOSEN).replace(") , best AS", "), best AS"))
def run_strip(s, sf):
    """A strip of the nearest raster's pixels of each feature, those outside the features empty."""
    r = x.Rasters(tables.raster_list(s, GRIDS, 1), fx.flag_pixels(s, sf).select("rid", "col", "row", "band1"))
    return x.strip(fx.box_layer(s, sf), r, x.Options(duplicate=[("distance",)], separation=1, only_inside=True))[1]


@query(with_("linecells", 'SELECT c AS col, r AS "row", CAST(CASE WHEN k.col IS NULL THEN 0 ELSE 300 END AS SMALLINT) AS value FROM (SELECT CAST(range AS INTEGER) AS c FROM range(64)) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS r FROM range(64)) b LEFT JOIN (SELECT DISTINCT col, "row" FROM linecells) k ON k.col = c AND k."row" = r'))
def run_rasterized(s, sf):
    at = lambda a, b: F.concat_ws(" ", a, b)
    f = fx.segments(s, sf).withColumn("wkt", F.concat(F.lit("LINESTRING ("), at("x1", "y1"), F.lit(","), at("x2", "y2"), F.lit(")")))
    f = f.withColumns({"minx": F.least("x1", "x2"), "maxx": F.greatest("x1", "x2"), "miny": F.least("y1", "y2"), "maxy": F.greatest("y1", "y2")})
    return x.rasterized(f, MAIN, value=300)


WIDE = """WITH size AS (SELECT 64 * greatest(1, CAST(floor(sqrt(count(*) / 1500)) AS BIGINT)) AS n FROM lineitem),
  pix AS (SELECT CAST((l_orderkey * 7 + l_linenumber * 13) % n AS INTEGER) AS col, CAST((l_partkey * 11 + l_suppkey * 3 + l_orderkey) % n AS INTEGER) AS "row", max(CAST(floor(l_quantity) AS INTEGER)) AS band1 FROM lineitem CROSS JOIN size GROUP BY ALL),
  b AS (SELECT c_custkey AS fid, n, CAST((c_custkey * 37) % 7000 AS DOUBLE) / CAST(7000 AS DOUBLE) * n AS x, CAST((c_custkey * 53) % 7000 AS DOUBLE) / CAST(7000 AS DOUBLE) * n AS y FROM customer CROSS JOIN size),
  e AS (SELECT fid, n, greatest(x - 6.5::DOUBLE, 0) AS u0, least(x + 6.5::DOUBLE, n - 1) AS u1, n - least(y + 4.5::DOUBLE, n) AS v0, n - greatest(y - 4.5::DOUBLE, 1) AS v1 FROM b),
  k AS (SELECT *, CAST(unnest(range(CAST(floor(v0) AS BIGINT), CAST(ceil(v1) AS BIGINT))) AS INTEGER) AS "row" FROM (SELECT *, CAST(unnest(range(CAST(floor(u0) AS BIGINT), CAST(ceil(u1) AS BIGINT))) AS INTEGER) AS col FROM e WHERE u0 < u1 AND v0 < v1))
  SELECT fid, count(*) AS "numPixels", CAST(sum(band1) AS DOUBLE) AS sum_band1, CAST(max(band1) AS DOUBLE) AS max_band1 FROM k JOIN pix USING (col, "row")
  WHERE (least(u1, col + 1) - greatest(u0, col)) * (least(v1, "row" + 1) - greatest(v0, "row")) >= """ + repr(0.5 - EPS) + " GROUP BY fid"


@query(WIDE)
def wide_zonal_stats(s, sf):
    """A raster whose size follows the tables."""
    n = fx.wide_size(s, sf)
    g = Grid(n, n, 0.0, float(n), rid="dir/wide.img")
    cells = rasterize.boxes_to_cells(rasterize.dealt(fx.wide_boxes(s, sf, n)), g).select("fid", "col", "row")
    px = extract.join_pixels(cells, fx.wide_pixels(s, sf, n), area=g.area)
    return stats.zonal_stats(px, ["band1"], ["sum", "max"])


# lookups over several rasters


def _flag_lookup(name: str, g) -> str:
    return f"""(SELECT col + {int(g.x0)} AS c, "row" - {int(g.y0) - 64} AS r, band1 AS "Band_1_{name}" FROM pix3 WHERE rid = '{g.rid}')"""


@query(with_("pts pix3", f"""SELECT fid, "Band_1_A", "Band_1_N" FROM (SELECT fid, CAST(floor(x) AS INTEGER) AS c, CAST(floor(64 - y) AS INTEGER) AS r FROM pts) LEFT JOIN {_flag_lookup('A', GRIDS[0])} USING (c, r) LEFT JOIN {_flag_lookup('N', GRIDS[1])} USING (c, r)"""))
def update_table_by_xy(s, sf):
    px = fx.flag_pixels(s, sf)
    rasters = [(g, px.where(F.col("rid") == g.rid), n) for g, n in zip(GRIDS[:2], "AN")]
    return legacy.add_band_values(fx.points(s, sf).select("fid", "x", "y"), rasters, ["band1"]).select("fid", "Band_1_A", "Band_1_N")


@query(with_("pix pix3", """SELECT p.col + 1 AS col, p."row" + 1 AS "row", a.band1 AS "Band_1_A" FROM pix p LEFT JOIN (SELECT * FROM pix3 WHERE rid = 'dir/A.img') a USING (col, "row")"""))
def update_table_by_cell(s, sf):
    rows = fx.main_pixels(s, sf).select((F.col("col") + 1).alias("col"), (F.col("row") + 1).alias("row"))
    return legacy.add_band_values(rows, [(GRIDS[0], fx.flag_pixels(s, sf).where(F.col("rid") == GRIDS[0].rid), "A")], ["band1"], by="cell")


FIELD = "CASE fid % 3 WHEN 0 THEN 'A.img' WHEN 1 THEN 'N.img' ELSE 'R.img' END"


@query(with_("pts pix3 rasters", f"""SELECT fid, rid AS path, col, "row", band1 FROM (SELECT fid, r.rid, CAST(floor((x - x0) / px) AS INTEGER) AS col, CAST(floor((y - y0) / py) AS INTEGER) AS "row" FROM pts JOIN rasters r ON r.rid = 'dir/' || {FIELD}) JOIN pix3 USING (rid, col, "row")"""))
def raster_named_by_field(s, sf):
    f = fx.points(s, sf).withColumn("image", F.expr(FIELD))
    return legacy.per_feature_raster(f, "image", tables.raster_list(s, GRIDS, 3), fx.flag_pixels(s, sf), ["band1"], "dir")


@query(with_("pts pix3", """, n AS (SELECT *, CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END AS c FROM pts), h AS (
  """ + " UNION ALL ".join(f"""SELECT fid, {k} AS idx, CAST(CASE WHEN x - {g.x0} < 0 THEN -floor({g.x0} - x + 0.5) ELSE floor(x - {g.x0} + 0.5) END AS INTEGER) AS col, CAST(CASE WHEN {g.y0} - y < 0 THEN -floor(y - {g.y0} + 0.5) ELSE floor({g.y0} - y + 0.5) END AS INTEGER) AS "row", '{g.rid}' AS rid FROM pts""" for k, g in enumerate(GRIDS)) + """)
  SELECT fid, idx, col, "row", band1, band2 FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY idx) AS k FROM h JOIN pix3 USING (rid, col, "row") WHERE band1 <> 0 OR band2 <> 0) WHERE k = 1""").replace(") , n AS", "), n AS"))
def extract_points(s, sf):
    return legacy.extract_points(fx.points(s, sf), tables.raster_list(s, GRIDS, 3), fx.flag_pixels(s, sf), ["band1", "band2"])


@query(with_("got3", """, st AS (SELECT fid, rid, c_nationkey, CAST(max(band1) AS DOUBLE) AS m1, CAST(max(band2) AS DOUBLE) AS m2 FROM got3 GROUP BY ALL)
  SELECT fid AS "FID", c_nationkey, rid AS "RID", 1 AS "BandNumber", CAST(n_nationkey AS DOUBLE) AS "FieldBandValue", m1 AS "max_ImageBandValue", CAST(0 AS DOUBLE) AS "sum_ImageBandValue" FROM st JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT fid, c_nationkey, rid, 2, CAST(n_regionkey AS DOUBLE), m2, CAST(0 AS DOUBLE) FROM st JOIN nation ON n_nationkey = c_nationkey""").replace(") , st AS", "), st AS"))
def calibration(s, sf):
    lib = fx.table(s, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("v1"), F.col("n_regionkey").alias("v2"))
    st = stats.zonal_stats(got3(s, sf), ["band1", "band2"], ["max", "sum"], keys=["fid", "rid"], attrs=["c_nationkey"])
    return legacy.calibration(lib, st, "c_nationkey", ["band1", "band2"], ["max", "sum"])


@query(with_("got", """SELECT fid || ':' || col || ':' || "row" || ':' || printf('%f', CAST(col AS DOUBLE)) || ':' || printf('%f', CAST(64 - "row" AS DOUBLE)) AS name, CAST(band1 AS DOUBLE) AS v1, CAST(band2 AS DOUBLE) AS v2, c_mktsegment FROM got"""))
def spectral_library(s, sf):
    out = legacy.spectra(got(s, sf), MAIN, ["band1", "band2"], ["c_mktsegment"])
    return out.select("name", F.col("spectrum")[0].alias("v1"), F.col("spectrum")[1].alias("v2"), "c_mktsegment")


MANY = """WITH pix AS (SELECT l_partkey % 64 AS k, CAST((l_orderkey * 7 + l_linenumber * 13) % 64 AS INTEGER) AS col, CAST((l_partkey * 11 + l_suppkey) % 64 AS INTEGER) AS "row", max(CAST(floor(l_quantity) AS INTEGER)) AS band1 FROM lineitem GROUP BY ALL),
  g AS (SELECT range AS k, CAST(64 * (range % 8) AS DOUBLE) AS gx, CAST(64 * (range // 8) + 64 AS DOUBLE) AS gy FROM range(64)),
  b AS (SELECT c_custkey AS fid, CAST((c_custkey * 37) % 7000 AS DOUBLE) / CAST(7000 AS DOUBLE) * 512::DOUBLE AS x, CAST((c_custkey * 53) % 7000 AS DOUBLE) / CAST(7000 AS DOUBLE) * 384::DOUBLE AS y FROM customer),
  e AS (SELECT fid, k, greatest(x - 6.5::DOUBLE, gx) - gx AS u0, least(x + 6.5::DOUBLE, gx + 63) - gx AS u1, gy - least(y + 4.5::DOUBLE, gy) AS v0, gy - greatest(y - 4.5::DOUBLE, gy - 63) AS v1 FROM b JOIN g ON x + 6.5::DOUBLE >= gx AND x - 6.5::DOUBLE <= gx + 63 AND y + 4.5::DOUBLE >= gy - 63 AND y - 4.5::DOUBLE <= gy),
  c AS (SELECT *, CAST(unnest(range(CAST(floor(v0) AS BIGINT), CAST(ceil(v1) AS BIGINT))) AS INTEGER) AS "row" FROM (SELECT *, CAST(unnest(range(CAST(floor(u0) AS BIGINT), CAST(ceil(u1) AS BIGINT))) AS INTEGER) AS col FROM e WHERE u0 < u1 AND v0 < v1))
  SELECT fid, 'dir/t' || k || '.img' AS rid, count(*) AS "numPixels", CAST(sum(band1) FILTER (band1 <> 50) AS DOUBLE) AS sum_band1, median(CAST(CASE WHEN band1 <> 50 THEN band1 END AS DOUBLE)) AS median_band1, count(*) FILTER (band1 = 50) AS nulls_band1 FROM c JOIN pix USING (k, col, "row")
  WHERE (least(u1, col + 1) - greatest(u0, col)) * (least(v1, "row" + 1) - greatest(v0, "row")) >= """ + repr(0.5 - EPS) + " GROUP BY fid, k"


@query(MANY)
def many_rasters_stats(s, sf):
    """Statistics over 64 rasters, a part of which features meet: one branch of a plan."""
    r = x.Rasters(tables.raster_list(s, fx.MANY, 1), fx.many_pixels(s, sf))
    return x.statistics(fx.many_boxes(s, sf), r, x.Options(fields="none", stats=["sum", "median", "nulls"]))


#: The flagship query.
entry = zonal_avg_points
