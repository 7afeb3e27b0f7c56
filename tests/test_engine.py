"""Sources, sinks, options, plans and streaming."""

import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.grid import Grid
from quern.operators import extract, select, stats
from quern.plans import extraction as x
from quern.plans import queries as plans
from quern.sources import fixtures as fx
from quern.sources import sinks, tables


@pytest.fixture(scope="module")
def raster(spark):
    g = Grid(12, 8, 0.0, 8.0, 1.0, -1.0, "a/one.img", "s")
    rows = [(c, r, c * 10 + r, float(c) / 2) for c in range(12) for r in range(8)]
    return g, spark.createDataFrame(rows, "col int, row int, band1 int, band2 double")


@pytest.fixture(scope="module")
def layer(spark):
    rows = [(1, "POLYGON ((1 1,4 1,4 4,1 4,1 1))", "a"), (2, "POINT (5.5 5.5)", "b"), (3, "LINESTRING (0.5 7.5,6.5 7.5)", "a"), (4, "POINT (50 50)", "c")]
    return tables.with_bounds(spark.createDataFrame(rows, "fid long, wkt string, name string"))


def test_table_and_statistics(raster, layer):
    out = x.table(layer, [raster]).toPandas()
    assert list(out.columns) == ["FID", "name", "RID", "col", "row", "x", "y", "band1", "band2"]
    assert out.groupby("FID").size().to_dict() == {1: 9, 2: 1, 3: 7} and set(out.RID) == {"one.img"}
    s = {r.fid: r for r in x.statistics(layer, [raster], x.Options(stats=["avg", "stdev", "nulls"])).collect()}
    assert s[2].avg_band1 == 52 and s[2].stdev_band1 == 0 and s[2].nulls_band1 == 0 and s[2].numPixels == 1
    assert {r.fid for r in x.statistics(layer, [raster], x.Options(fid=2)).collect()} == {2}
    assert {r.fid for r in x.statistics(layer, [raster], x.Options(where="name = 'a'")).collect()} == {1, 3}
    assert x.table(layer, [raster], x.Options(box=("2px",), fields="none")).where("FID = 2").count() == 5  # the middle, and four halves
    assert x.table(layer, [raster], x.Options(buffer=(2, 4), rid="none", xy=False, col_row=False)).columns == ["FID", "name", "band1", "band2"]
    with pytest.raises(ValueError):
        x.Options(box=("1",), buffer=(1,))
    with pytest.raises(ValueError):
        x.Options(pixprop=2)
    with pytest.raises(ValueError):
        x.table(layer, [raster], x.Options(fields=["nope"]))
    with pytest.raises(ValueError):
        x.table(layer, [raster], x.Options(fid=99))


def test_cutouts_strip_burn(raster, layer):
    windows, pixels = x.mini_rasters(layer, raster, x.Options(only_inside=True, nodata=-9, parity="odd"))
    w = {r.fid: r for r in windows.collect()}
    assert (w[1].width, w[1].height, w[3].width, w[3].name) == (3, 3, 7, "0003.img") and pixels.where("fid = 1").count() == 9
    layout, full, moved = x.strip(layer, raster, x.Options(separation=1))
    assert [(r.fid, r.strip_row) for r in layout.orderBy("fid").collect()] == [(1, 0), (2, 4), (3, 6)]
    m = {r.fid: r for r in moved.collect()}
    assert m[2].wkt == "POINT (0.5 -4.5)" and m[2].name == "b" and m[2].RID == "one.img"
    assert full.count() == 7 * 7 and full.where("fid = -1 and x = 0").count() > 0
    assert x.rasterized(layer, raster[0], value=5).where("value = 5").count() == 17
    assert [r["class"] for r in x.classes(layer, [raster]).where("fid = 2").collect()] == [52]


def test_statistics_of_ties_and_nodata(spark):
    rows = [(1, 0, k, v, float(v)) for k, v in enumerate([3, 3, 2, 2, 9])] + [(2, 0, 0, 9, float("nan")), (3, 0, 0, 9, 10.0), (3, 0, 1, 9, 9.0)]
    px = spark.createDataFrame(rows, "fid long, col int, row int, a int, b double")
    s = {r.fid: r for r in stats.zonal_stats(px.select("fid", "col", "row", "a"), ["a"], list(stats.STATS), nodata=9).collect()}
    assert (s[1].mode_a, s[1].median_a, s[1].nulls_a, s[1].numPixels) == (2, 2.5, 1, 5)
    assert s[2].avg_a is None and s[2].nulls_a == 1
    c = {r.fid: r for r in stats.zonal_stats(px.select("fid", "col", "row", "a"), ["a"], ["avg", "nulls"], nodata=9, compat=True).collect()}
    assert c[2].avg_a == 0 and c[2].nulls_a == 0
    f = {r.fid: r for r in stats.zonal_stats(px, ["b"], ["mode", "nulls"], nodata=float("nan")).collect()}
    assert f[3].mode_b == 10.0 and f[2].nulls_b == 1  # "10.000" comes before "9.000"
    with pytest.raises(ValueError):
        stats.zonal_stats(px, ["a"], ["nope"])
    with pytest.raises(ValueError):
        stats.count_by_class(px, "b")


def test_three_decimals_round_as_c_does(spark):
    import random

    r = random.Random(4)
    values = [1.0005, 1.0015, 2.0005, 0.0625, 0.1875, -0.0625, -1.0005, 0.0005, -0.0005, 0.0004999, 1e-9, -1e-9, 123456.7895, 987654321.0625, 0.0, -0.0, 5e-324, 3.0, 1e10 + 0.0005, 8.5]
    values += [round(r.uniform(-1000, 1000), 4) for _ in range(3000)] + [r.uniform(-1e6, 1e6) for _ in range(500)] + [k / 16 for k in range(-200, 200)] + [math.nextafter(k / 2000, 9) for k in range(1, 400, 2)]
    got = [x.s for x in spark.createDataFrame([(v,) for v in values], "v double").select(stats.three_decimals(F.col("v")).alias("s")).collect()]
    assert [(v, g) for v, g in zip(values, got) if g != "%.3f" % v] == []


def test_statistics_from_counts(spark):
    import random

    r = random.Random(6)
    rows = [(f, k, r.randint(0, 6), r.choice([1.0005, 1.0006, 2.5, -3.25, float("nan"), None])) for f in range(12) for k in range(f)]
    px = spark.createDataFrame(rows, "fid long, col int, a int, b double").withColumn("row", F.lit(0))
    names = list(stats.STATS)
    for bands, nodata in ((["a"], 3), (["b"], float("nan")), (["a", "b"], 1)):
        for compat in (False, True):
            one, two = (f(px, bands, names, ["fid"], nodata=nodata, compat=compat) for f in (stats.zonal_stats, stats.two_step_stats))
            assert sorted(map(str, one.select(two.columns).collect())) == sorted(map(str, two.collect()))


def test_nodata_of_rasters(spark, layer):
    """Each raster's own nodata, unless a value is given, which may be 0; class counts are a raster's own."""
    def grid(name, nodata):
        return Grid(12, 8, 0.0, 8.0, 1.0, -1.0, name, "s", nodata)

    flat = lambda v: spark.createDataFrame([(c, r, v) for c in range(12) for r in range(8)], "col int, row int, band1 int")
    rasters = [(grid("a", -9.0), flat(-9)), (grid("b", None), flat(0)), (grid("c", -9.0), flat(5))]
    got = {(r.fid, r.rid): (r.avg_band1, r.nulls_band1, r.numPixels) for r in x.statistics(layer, rasters, x.Options(stats=["avg", "nulls"])).collect()}
    assert got[1, "a"] == (None, 9, 9) and got[1, "b"] == (0, 0, 9) and got[1, "c"] == (5, 0, 9) and len(got) == 9
    got = {(r.fid, r.rid): r.avg_band1 for r in x.statistics(layer, rasters, x.Options(nodata=0.0)).collect()}
    assert got[1, "a"] == -9 and got[1, "b"] is None
    counts = {(r.fid, r.rid, r["class"]): r["count"] for r in x.classes(layer, rasters).collect()}
    assert counts[1, "a", -9] == counts[1, "b", 0] == counts[1, "c", 5] == 9
    with pytest.raises(ValueError):
        x.statistics(layer, [rasters[0], rasters[0]])


def test_pairs_of_tiles(spark):
    """Features and rasters by tiles are those of plain comparison, each pair once."""
    import random

    r = random.Random(8)
    grids = [Grid(r.randint(3, 40), r.randint(3, 40), r.uniform(-50, 50), r.uniform(-50, 50), 1.0, -1.0, f"r{k}") for k in range(15)]
    boxes = [(k, a, b, a + r.uniform(0, 60), b + r.uniform(0, 60)) for k in range(80) for a, b in [(r.uniform(-90, 90), r.uniform(-90, 90))]] + [(100, None, None, None, None), (101, 0.0, 0.0, 0.0, 0.0)]
    f = spark.createDataFrame(boxes, "fid long, minx double, miny double, maxx double, maxy double")
    table = tables.raster_list(spark, grids)
    for holds in (False, True):
        got = sorted((p.fid, p.rid) for p in extract.paired(f, table, holds=holds).select("fid", "rid").collect())
        meets = lambda b, e: e[0] <= b[1] and b[3] <= e[2] and e[1] <= b[2] and b[4] <= e[3] if holds else b[3] >= e[0] and b[1] <= e[2] and b[4] >= e[1] and b[2] <= e[3]  # noqa: B023, E731
        assert got == sorted((b[0], g.rid) for b in boxes if b[1] is not None for g in grids if meets(b, g.envelope()))


def test_choice(spark):
    c = spark.createDataFrame([(1, 0, "a", 3.0, 4.0), (1, 1, "b", 3.0, 4.0), (1, 2, "c", 60.0, 0.0), (2, 1, "b", 9.0, 9.0)], "fid long, idx int, rid string, dx double, dy double")
    got = lambda m, **k: {r.fid: r.rid for r in select.choose(c, m, **k).collect()}
    assert got([("distance",)]) == {1: "a", 2: "b"} and got([]) == {1: "a", 2: "b"}
    assert got([("direction", 0)])[1] == "c" and got([("direction", 360)])[1] != "c" and got([("direction", 360)], wrap=True)[1] == "c"


def test_envi_round_trip(spark, raster, tmp_path):
    g, px = raster
    sinks.write_envi(px, g, ["band1", "band2"], str(tmp_path / "one.img"), 4)
    back, g2 = tables.read_envi(spark, str(tmp_path / "one.img"), str(tmp_path / "one.hdr"))
    assert (g2.width, g2.height, g2.x0, g2.y0, g2.px, g2.py) == (12, 8, 0, 8, 1, -1)
    pixels = lambda df: sorted((r.col, r.row, float(r.band1), r.band2) for r in df.collect())
    assert pixels(back) == pixels(px)
    data = np.fromfile(tmp_path / "one.img", "<f4").reshape(2, 8, 12)
    for name, order in (("bil", (1, 0, 2)), ("bip", (1, 2, 0)), ("bsq", (0, 1, 2))):
        own = np.ascontiguousarray(data.transpose(order))
        line = own[0].nbytes if name != "bsq" else 12 * 4
        for skip in (0, 2 * line):
            (tmp_path / f"{name}.img").write_bytes(b"h" * skip + own.tobytes())
            (tmp_path / f"{name}.hdr").write_text((tmp_path / "one.hdr").read_text().replace("bsq", name).replace("offset = 0", f"offset = {skip}"))
            again, _ = tables.read_envi(spark, str(tmp_path / f"{name}.img"), str(tmp_path / f"{name}.hdr"))
            assert pixels(again) == pixels(px)
    (tmp_path / "big.img").write_bytes(data.astype(">f4").tobytes())
    (tmp_path / "big.hdr").write_text((tmp_path / "one.hdr").read_text().replace("byte order = 0", "byte order = 1"))
    assert pixels(tables.read_envi(spark, str(tmp_path / "big.img"), str(tmp_path / "big.hdr"))[0]) == pixels(px)
    turned = tables.envi_grid({"samples": "4", "lines": "4", "map info": "{UTM, 1, 1, 10, 20, 2, 2, 10, North, rotation=90}"})
    assert np.allclose(turned.corner(1, 0), (10, 22)) and np.allclose(turned.corner(0, 1), (12, 20))
    with pytest.raises(ValueError):
        x.Rasters.of([(turned, px)])


def test_headers_of_the_survey(spark, tmp_path):
    """Sizes and corners that the survey's cut-outs and strip have, as this writes them."""
    g = Grid(157, 131, 743009.826, 4334940.54, 1.0, -1.0, srs="UTM,10,North")
    text = sinks.envi_header(g, 4, 2)
    for line in ("samples = 157", "lines   = 131", "bands   = 4", "data type = 2", "interleave = bsq", "map info = {UTM, 1, 1, 743009.826000, 4334940.540000, 1.000000, 1.000000, 10, North}"):
        assert line in text.splitlines()
    assert tables.envi_grid(tables.parse_envi_header(text)).x0 == 743009.826
    big = Grid(400, 400, 742901.826, 4335165.54, 1.0, -1.0, "one", "UTM,10,North")
    table = tables.raster_list(spark, [big])
    corners = {0: (108, 225, 157, 131), 3: (0, 92, 31, 101), 4: (260, 74, 48, 26), 5: (356, 134, 43, 81)}
    cells = spark.createDataFrame([(f, "one", c, r) for f, (c, r, w, h) in corners.items() for c, r in ((c, r), (c + w - 1, r + h - 1))], "fid long, rid string, col int, row int")
    from quern.operators import cutout

    windows = cutout.cutout_windows(cells, table, "p_", keys=["fid", "rid"])
    assert {(r.fid, r["name"], r.col0, r.row0, r.width, r.height) for r in windows.collect()} == {(f, f"p_{f:04d}.img", *v) for f, v in corners.items()}
    assert tuple(cutout.strip_size(cutout.strip_layout(windows)).first()) == (157, 339)


def test_delimited_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"q')], "i int, s string").coalesce(1)
    path = str(tmp_path / "t.csv")
    assert sinks.append_file(df, path) == 2 and open(path).read() == 'i,s\n1,"a,b"\n2,q"q\n'
    with open(path, "rb+") as f:
        f.truncate(os.path.getsize(path) - 1)
    sinks.append_file(df.limit(1), path)
    assert open(path).read() == 'i,s\n1,"a,b"\n2,q"q\n1,"a,b"\n'
    (tmp_path / "m.txt").write_text("a b;c\n1;2 3\n")
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "m.txt"), " ;").collect()] == [("1", "2", "3")]
    (tmp_path / "q.txt").write_text('a;b\n"x;y";2\na;b\n3\n4 "5 ""6""";7\n')
    assert sorted((tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "q.txt"), "; ").collect()), key=str) == [("3", None), ("4", '5 "6"'), ("a", "b"), ("x;y", "2")]
    sinks.write_table(df, str(tmp_path / "d"))
    sinks.write_table(df, str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).count() == 4


def test_tiles_prune(spark, sf, tmp_path):
    px = fx.flag_pixels(spark, sf).cache()
    sinks.write_pixels(px, str(tmp_path / "px"), tile=16)
    back = spark.read.parquet(str(tmp_path / "px"))
    cells = fx.flag_box_cells(spark, sf).where("fid < 20")
    on = ("rid", "tile", "col", "row")
    got = extract.join_pixels(extract.tiled(cells, 16), back, on).select("fid", "rid", "col", "row", "band1")
    want = extract.join_pixels(cells, px, ("rid", "col", "row")).select("fid", "rid", "col", "row", "band1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_spread_polygons(spark):
    g = Grid(50, 40, 0.0, 40.0)
    f = spark.createDataFrame([(1, "POLYGON ((-5 -5,60 -5,60 60,-5 60,-5 -5))")], "fid long, wkt string")
    from quern.operators.rasterize import geometries_to_cells

    a, b = (sorted(map(tuple, geometries_to_cells(f, g, edge_mode="full", spread=k).collect())) for k in (False, True))
    assert a == b and len(a) == 2000


def test_layers(spark, tmp_path, layer):
    layer.write.parquet(str(tmp_path / "l.parquet"))
    assert tables.layer(spark, str(tmp_path / "l.parquet")).count() == 4
    layers = {"a": layer, "b": layer.limit(0)}
    assert tables.choose_layer(layers, "b").count() == 0 and tables.choose_layer(layers, "zzz").count() == 4
    assert tables.pair_masks([1, 2, 3], ["m"]) == [(1, "m")]
    layer.createOrReplaceTempView("some_layer")
    assert tables.resolve(spark, "some_layer").count() == 4
    other = Grid(12, 8, 1.0, 8.0)
    with pytest.raises(ValueError):
        extract.stack(layer, layer, Grid(12, 8, 0.0, 8.0), other)


def test_plans_have_no_nested_loops(spark, sf):
    plan = extract.join_pixels(fx.box_cells(spark, sf), fx.main_pixels(spark, sf))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    rasters = x.Rasters(tables.raster_list(spark, fx.GRIDS, 3), fx.flag_pixels(spark, sf))
    for out in (x.table(fx.box_layer(spark, sf), rasters), x.statistics(fx.box_layer(spark, sf), rasters, x.Options(stats=["mode", "avg"]))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    cells = x.cells_of(fx.box_layer(spark, sf), rasters, x.Options())._jdf.queryExecution().executedPlan().toString()
    assert cells.count("MapInArrow") == 1 and cells.count("FileScan") == 1
    narrow = x.statistics(fx.box_layer(spark, sf), rasters.of_bands("band1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "band3" not in narrow.split("Relation")[0]
    read = fx.main_pixels(spark, sf).select("col", "row", "band1")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in read.split("ReadSchema")[-1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_large_rasters_are_not_broadcast(spark):
    """The planner takes 117 cells a feature for the feature's few bytes."""
    plan = plan_of(plans.QUERIES["wide_zonal_stats"](spark, "/root/testdata/sf0.1"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_images_read_geometries_once(spark, sf):
    """Windows, strips and what lies inside read stored spans; cells made of them are not broadcast."""
    for name in ("run_strip", "run_mini_rasters", "run_windows"):
        plan = plan_of(plans.QUERIES[name](spark, sf))
        assert "MapInArrow" not in plan, name
    inside = plan_of(plans.QUERIES["run_mini_rasters"](spark, sf))
    assert "SortMergeJoin [fid" in inside


def test_rasters_meet_features_everywhere(spark, sf):
    """Features joined with the few tiles of rasters by an exchange would be the work of as many tasks."""
    o = x.Options(fields="none", duplicate=[("distance",)])
    rasters = x.Rasters(tables.raster_list(spark, fx.GRIDS, 1), fx.flag_pixels(spark, sf).select("rid", "col", "row", "band1"))
    for df in (select.candidates(fx.box_layer(spark, sf), rasters.table), x.pairs(fx.box_layer(spark, sf), rasters, o)):
        assert "BroadcastHashJoin [__tx" in plan_of(df)

def test_cells_are_not_exchanged_for_small_rasters(spark, sf):
    plan = plan_of(plans.QUERIES["run_table"](spark, sf))
    assert "BroadcastHashJoin [rid" in plan
    assert plan.index("Generate") < plan.index("SortMergeJoin [fid")  # attributes join spans, below the cells

def test_features_are_dealt_before_python(spark, sf):
    """The layer is one small file: without an exchange its buffers and cells are the work of one task."""
    for name in ("run_buffers", "buffered_points", "polygon_cells", "polygon_cells_of_boxes", "wkt_line_cells"):
        plan = plan_of(plans.QUERIES[name](spark, sf))
        below = plan.split("ArrowEvalPython" if "buffer" in name else "MapInArrow")[-1]
        assert "Exchange hashpartitioning(fid" in below, name

def test_disjoint_spans(spark):
    """Parts that overlap and rows of one fid give each cell once, and cells are not compared for that."""
    rows = [(1, "MULTIPOLYGON (((0 0,40 0,40 40,0 40,0 0)),((10.5 10.5,45 10.5,45 39,10.5 39,10.5 10.5)))"), (1, "POLYGON ((2 2,47 3,20 39,2 2))"), (2, "MULTIPOINT (5.5 5.5,5.5 5.5,6.5 5.5)"), (2, "LINESTRING (1.5 5.5,9.5 5.5,4.5 1.5,4.5 9.5)")]
    layer = tables.with_bounds(spark.createDataFrame(rows, "fid long, wkt string"))
    rasters = x.Rasters.of([(Grid(50, 40, 0.0, 40.0, rid="a"), spark.createDataFrame([(3, 30, 1)], "col int, row int, band1 int"))])
    want = x.cells_of(layer, rasters, x.Options()).select("fid", "rid", "col", "row")
    got = x.distinct_cells(layer, rasters, x.Options())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.distinct().collect())) and want.count() > got.count()
    assert "Aggregate" not in plan_of(got)

def test_cells_of_segments_once(spark, sf):
    """Segments are exchanged by feature, not their cells; only features of several segments are compared by cell."""
    from quern.operators import rasterize

    s = fx.segments(spark, sf).limit(200).withColumn("fid", F.col("fid") % 120)
    cells = rasterize.segments_to_cells(s, fx.MAIN).select("fid", "col", "row")
    got = rasterize.segments_to_distinct_cells(s, fx.MAIN)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cells.distinct().collect())) and got.count() < cells.count()
    plan = plan_of(got)
    assert "hashpartitioning(fid" in plan and not [n for n in plan.splitlines() if "Exchange" in n and "col#" in n.split("hashpartitioning")[-1]]

def test_statistics_read_geometries_once(spark, sf):
    """Mode and median are a second pass over the cells, of stored spans."""
    for name in ("many_rasters_stats", "run_statistics"):
        assert "MapInArrow" not in plan_of(plans.QUERIES[name](spark, sf)), name

def test_streamed_points(spark, sf, tmp_path):
    from quern.streaming.zonal import stream_points, stream_zone_counts

    p = fx.points(spark, sf).withColumn("at", F.timestamp_seconds(F.col("fid") * 600))
    p.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    pixels = fx.main_pixels(spark, sf)
    q = stream_points(src, pixels, fx.MAIN, ["band1"]).select("fid", "band1").writeStream.format("memory").queryName("arrived").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = extract.join_pixels(fx.point_cells(spark, sf), pixels).select("fid", "band1")
    assert sorted(map(tuple, spark.table("arrived").collect())) == sorted(map(tuple, want.collect()))
    q = stream_zone_counts(src, pixels, fx.MAIN, "at").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert 0 < spark.table("windows").agg(F.sum("pixels")).first()[0] <= want.count()


@pytest.fixture(scope="module")
def files(raster, layer, tmp_path_factory):
    """A layer as Parquet and shapefile, and two rasters as ENVI files."""
    d = tmp_path_factory.mktemp("files")
    g, px = raster
    sinks.write_envi(px, g, ["band1"], str(d / "one.img"), 2)
    sinks.write_envi(px.withColumn("band1", -F.col("band1")), g, ["band1"], str(d / "two.img"), 2)
    layer.drop("minx", "miny", "maxx", "maxy").write.parquet(str(d / "l.parquet"))
    os.makedirs(d / "layers")
    sinks.write_shapefile(layer.where("fid = 1"), str(d / "layers" / "ply.shp"))
    sinks.write_shapefile(layer.where("fid in (2, 4)"), str(d / "layers" / "pt.shp"))
    return d


def cli(spark, *words):
    from quern.__main__ import arguments, run

    run(arguments([str(w) for w in words]), spark)


def test_command_line(files, tmp_path, spark):
    from quern.__main__ import command, duplicate_modes

    assert duplicate_modes("ignore_nodata band 2 direction 45 distance".split()) == ([("direction", 45.0), ("distance",)], "band 2")
    base = ["--vector", files / "l.parquet", "--raster", files / "one.img"]
    for kind in ("table", "stats", "classes", "mini_rasters", "mini_raster_strip", "rasterize", "report"):
        cli(spark, *base, "--out-type", kind, "--out", tmp_path / kind)
        assert os.listdir(tmp_path / kind)
    assert spark.read.csv(str(tmp_path / "table"), header=True).count() == 17
    assert command(["csv", "vector=v", "rasters=a,b", "output=o.csv", "masks=c,d", "duplicate_pixel=distance,direction 45"])[2:] == ["--vector", "v", "--raster", "a", "b", "--table-suffix", "o.csv", "--mask", "c", "d", "--duplicate", "distance", "direction", "45"]
    for bad in (["csv", "vector=v", "rasters=a"], ["report"], ["csv", "vector=v", "rasters=a", "output=o", "masks=c,d"], ["rasterize", "vector=v", "rasters=a", "output=o", "x=1"]):
        with pytest.raises(ValueError):
            command(bad)


def test_outputs_of_one_run(files, tmp_path, spark):
    """Table, summary and class counts by suffixes of one prefix, in order; both rasters are used."""
    cli(spark, "--vector", files / "l.parquet", "--raster", files / "one.img", files / "two.img", "--validate_inputs", "--out-prefix", f"{tmp_path}/p", "--table-suffix", "_t.csv", "--summary-suffix", "_s.csv", "--class-summary-suffix", "_c.csv", "--stats", "avg", "min")
    rows = [x.split(",") for x in open(tmp_path / "p_t.csv").read().splitlines()]
    assert rows[0] == ["FID", "name", "RID", "col", "row", "x", "y", "band1"] and len(rows) == 1 + 34
    assert [r[2] for r in rows[1:]] == ["one.img"] * 17 + ["two.img"] * 17 and [r[0] for r in rows[1:18]] == ["1"] * 9 + ["2"] + ["3"] * 7
    assert [(r[3], r[4]) for r in rows[1:10]] == [(str(c), str(r)) for c in (2, 3, 4) for r in (5, 6, 7)]
    summary = open(tmp_path / "p_s.csv").read().splitlines()
    assert summary[0] == "fid,name,rid,numPixels,avg_band1,min_band1" and len(summary) == 7 and "52.000000" in summary[2]
    assert open(tmp_path / "p_c.csv").readline() == "fid,rid,class,count\n"
    before = len(open(tmp_path / "p_t.csv").read().splitlines())
    cli(spark, "csv", f"vector={files}/l.parquet", f"rasters={files}/one.img", f"output={tmp_path}/p_t.csv", "fields=name")
    assert len(open(tmp_path / "p_t.csv").read().splitlines()) == before + 17


def test_image_outputs(files, tmp_path, spark):
    """Cut-outs and strips as files: bands of both rasters, inside only, and the moved features."""
    two = ["--vector", files / "l.parquet", "--raster", files / "one.img", files / "two.img", "--in", "--nodata", "-99"]
    cli(spark, *two, "--out-type", "mini_rasters", "--out-prefix", f"{tmp_path}/m", "--srs", "here")
    h = tables.parse_envi_header(open(tmp_path / "m0001.hdr").read())
    assert (h["samples"], h["lines"], h["bands"], h["data type"]) == ("3", "3", "2", "2") and h["map info"].startswith("{here, 1, 1, 1.000000, 4.000000")
    image = np.fromfile(tmp_path / "m0001.img", "<i2").reshape(2, 3, 3)
    assert (image[0] == [[c * 10 + r for c in (1, 2, 3)] for r in (4, 5, 6)]).all() and (image[1] == -image[0]).all()
    cli(spark, *two, "--out-type", "mini_raster_strip", "--out-prefix", f"{tmp_path}/s", "--mrst-img-suffix", "_mr.img", "--separation", "1")
    h = tables.parse_envi_header(open(tmp_path / "s_mr.hdr").read())
    assert (h["samples"], h["lines"], h["bands"]) == ("7", "7", "2")
    fids = np.fromfile(tmp_path / "s_mrid.img", "<i4").reshape(7, 7)
    assert fids[0, 0] == 1 and fids[0, 3] == -1 and fids[3, 0] == -1 and fids[4, 0] == 2 and (fids[6] == 3).all()
    assert np.fromfile(tmp_path / "s_mrloc.glt", "<f4").reshape(2, 7, 7)[:, 0, 0].tolist() == [1, 4]
    strip = np.fromfile(tmp_path / "s_mr.img", "<i2").reshape(2, 7, 7)
    assert strip[0, 0, 0] == 14 and strip[0, 3, 0] == -99
    cli(spark, "--vector", files / "layers", "--layer", "ply", "--raster", files / "one.img", "--out-type", "mini_raster_strip", "--out-prefix", f"{tmp_path}/v", "--mrst-shp-suffix", "_mv.shp")
    assert tables.layer(spark, f"{tmp_path}/v_mv.shp").select("RID", "minx").first()[0] == "one.img"
    cli(spark, "rasterize", f"vector={files}/layers", "layer=pt", f"rasters={files}/one.img", f"output={tmp_path}/burnt.img", "value=7")
    assert np.fromfile(tmp_path / "burnt.img", "u1").reshape(8, 12)[2, 5] == 7 and np.fromfile(tmp_path / "burnt.img", "u1").sum() == 7


def test_text_outputs(files, tmp_path, spark, capsys):
    base = ["--vector", files / "l.parquet", "--raster", files / "one.img"]
    cli(spark, *base, "--dump_geometries", tmp_path / "d.txt", "--jtstest", tmp_path / "j.txt", "--show-fields")
    lines = open(tmp_path / "d.txt").read().splitlines()
    assert len(lines) == 1 + 13 + 9 + 5 + 5 + 1 + 2 + 1 + 17 and "name" in capsys.readouterr().out
    assert open(tmp_path / "j.txt").read().count("<case>") == 3
    (tmp_path / "lib.csv").write_text("name,v1\na,3\nb,4\n")
    cli(spark, *base, "--calibrate", tmp_path / "lib.csv", "name", "--out-prefix", f"{tmp_path}/k", "--stats", "avg")
    rows = open(tmp_path / "k_calibration.csv").read().splitlines()
    assert rows[0] == "FID,name,RID,BandNumber,FieldBandValue,avg_ImageBandValue" and len(rows) == 4


def test_layers_of_shapefiles(files, spark):
    one, first, unknown = (tables.layer(spark, str(files / "layers"), name=n) for n in ("pt", None, "zzz"))
    assert [(r.fid, r.wkt, r.name) for r in one.orderBy("fid").collect()] == [(0, "POINT (5.5 5.5)", "b"), (1, "POINT (50 50)", "c")]
    assert first.first().wkt.startswith("POLYGON") and unknown.count() == 1
    as_wkb = spark.createDataFrame([(1, bytes.fromhex("0101000000000000000000f03f0000000000000040"))], "fid long, wkb binary")
    assert tables.as_layer(as_wkb).select("wkt", "maxy").first() == ("POINT (1 2)", 2.0)


def test_geometry_counters(spark):
    from quern.operators import report

    ring = "(0 0,10 10,10 0,0 10,0 0)"
    f = spark.createDataFrame([(1, f"POLYGON ({ring})"), (2, f"POLYGON ({ring},(1 1,2 1,2 2,1 1))"), (3, "POINT (1 1)"), (4, "POLYGON ((0 0,1 0,1 1,0 0))"), (5, None)], "fid long, wkt string")
    got = {r.counter: r.value for r in report.geometry_counters(f).collect()}
    assert got == {"POLYGON": 3, "POINT": 1, "NONE": 1, "invalid": 2, "with interior ring": 1, "exploded": 1, "sub polygons": 2}


def test_spectra_files(spark, tmp_path):
    sp = spark.createDataFrame([("2:1:1", [1.5, 2.5, 3.5], "b"), ("1:1:1", [4.0, 5.0, 6.0], None)], "name string, spectrum array<double>, kind string")
    assert sinks.write_spectra(sp, str(tmp_path / "lib.sli"), ["kind"]) == 2
    assert np.fromfile(tmp_path / "lib.sli", "<f8").tolist() == [4, 5, 6, 1.5, 2.5, 3.5] and open(tmp_path / "lib_kind.ser").read() == "\nb\n"
    h = tables.parse_envi_header(open(tmp_path / "lib.hdr").read())
    assert (h["samples"], h["lines"], h["spectra names"]) == ("3", "2", "{1:1:1, 2:1:1}")
    sinks.write_spectra(sp, str(tmp_path / "im.img"), library=False)
    assert tables.parse_envi_header(open(tmp_path / "im.hdr").read())["bands"] == "3"


def test_observers(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 7), (2, 0, 0, 1)], "fid long, col int, row int, band1 int")
    import pandas as pd

    out = sinks.each_group(px, ["fid"], lambda key, part: pd.DataFrame({"fid": [key[0]], "spread": [int(part.band1.max() - part.band1.min())]}), "fid long, spread long")
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 0)]


def test_entry_without_the_subpackage(tmp_path):
    """The driver's contract holds when the optional parts are gone."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
