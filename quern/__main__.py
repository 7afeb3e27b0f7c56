"""Command line: ``python -m quern --vector V --raster R [R ...] --out-type table --out-prefix P --table-suffix S``.

Also as commands with ``name=value`` parameters: ``report``, ``csv`` and ``rasterize``.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from quern.operators import extract, legacy, report
from quern.plans import extraction as x
from quern.sources import sinks, tables

OUT_TYPES = ["table", "stats", "classes", "mini_rasters", "mini_raster_strip", "rasterize", "report"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--vector", help="layer with fid and wkt, wkb or x and y (Parquet, CSV, JSON), a shapefile, a folder of layers, or a view")
    p.add_argument("--layer", help="name of a layer in a folder of layers")
    p.add_argument("--raster", nargs="+", default=[], help="ENVI files; their headers end in .hdr")
    p.add_argument("--mask", nargs="+", default=[])
    p.add_argument("--validate_inputs", action="store_true")
    p.add_argument("--out-type", choices=OUT_TYPES)
    p.add_argument("--out", help="folder of one output; part files")
    p.add_argument("--out-prefix", default="", help="what the names of files begin with; suffixes say which are made")
    p.add_argument("--table-suffix")
    p.add_argument("--summary-suffix")
    p.add_argument("--class-summary-suffix")
    p.add_argument("--mr-img-suffix", default=None)
    p.add_argument("--mrst-img-suffix", default=None)
    p.add_argument("--mrst-shp-suffix", default=None)
    p.add_argument("--mrst-fid-suffix", default="_mrid.img")
    p.add_argument("--mrst-glt-suffix", default="_mrloc.glt")
    p.add_argument("--rasterize-suffix")
    p.add_argument("--dump_geometries")
    p.add_argument("--jtstest")
    p.add_argument("--report", action="store_true")
    p.add_argument("--show-fields", action="store_true")
    p.add_argument("--calibrate", nargs=2, metavar=("SPECLIB", "LINK"), help="spectral library, and the field that links it to features")
    p.add_argument("--fields", nargs="*")
    p.add_argument("--stats", nargs="+", default=["avg"])
    p.add_argument("--RID", choices=["file", "path", "none"], default="file")
    p.add_argument("--noColRow", action="store_true")
    p.add_argument("--noXY", action="store_true")
    p.add_argument("--pixprop", type=float, default=0.5)
    p.add_argument("--box", nargs="+")
    p.add_argument("--buffer", nargs="+")
    p.add_argument("--fid", type=int)
    p.add_argument("--where")
    p.add_argument("--sql", help="statement over the view `layer`")
    p.add_argument("--dialect", choices=["ansi", "spark"], default="spark", help="dialect of --sql")
    p.add_argument("--srs", help="reference system of cut-outs, instead of the raster's")
    p.add_argument("--nodata", type=float)
    p.add_argument("--duplicate", nargs="+", default=[], help="distance, direction <degrees>, ignore_nodata <all_bands|any_band|band n>")
    p.add_argument("--separation", type=int, default=0)
    p.add_argument("--parity")
    p.add_argument("--in", dest="inside", action="store_true")
    p.add_argument("--skip_invalid_polys", action="store_true")
    p.add_argument("--edge-mode", choices=["reference", "full"], default="reference")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--value", type=int, default=1)
    return p


def duplicate_modes(words: list[str]) -> tuple[list[tuple], str | None]:
    """(modes, ignore_nodata) of the words after ``--duplicate``."""
    modes, nodata, at = [], None, 0
    while at < len(words):
        if words[at] == "distance":
            modes.append(("distance",))
            at += 1
        elif words[at] == "direction":
            modes.append(("direction", float(words[at + 1])))
            at += 2
        elif words[at] == "ignore_nodata":
            n = 3 if words[at + 1] == "band" else 2
            nodata = " ".join(words[at + 1 : at + n])
            at += n
        else:
            raise ValueError(f"unknown mode {words[at]!r}")
    return modes, nodata


def options(a: argparse.Namespace) -> x.Options:
    modes, screened = duplicate_modes(a.duplicate)
    return x.Options(
        a.fields, a.RID, not a.noColRow, not a.noXY, a.pixprop, tuple(a.box) if a.box else None, tuple(a.buffer) if a.buffer else None, a.fid, a.where,
        a.skip_invalid_polys, a.edge_mode, a.nodata, a.stats, modes, screened, a.separation, a.parity, a.inside,
    )


def read_rasters(spark: SparkSession, paths: list[str]) -> list[x.Raster]:
    out = []
    for p in paths:
        px, g = tables.read_envi(spark, p, p.rsplit(".", 1)[0] + ".hdr", p)
        out.append((g, px))
    return out


def put(df: DataFrame, path: str, sep: str) -> None:
    """A path that ends in .csv or .txt is one local file, made or appended to; any other a folder of part files."""
    if path.endswith((".csv", ".txt")):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        sinks.append_file(df, path, sep)
    else:
        sinks.write_table(df, path, sep)


def dump(layer: DataFrame, rasters: list[x.Raster], o: x.Options) -> DataFrame:
    """Text lines of the grid, the envelope, the features' vertices and their pixels, in that order."""
    g, _ = rasters[0]
    cells = x.cells_of(layer, x.Rasters.of(rasters[:1]), o)
    return report.dump_geometries(x.chosen_features(layer, o), cells, g, o.edge_mode)


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    """All outputs that the options ask for; inputs are read once."""
    if not a.vector and not a.raster:
        raise ValueError("give a vector layer, a raster, or both")
    layer = tables.layer(spark, a.vector, name=a.layer) if a.vector else None
    if a.sql:
        layer.createOrReplaceTempView("layer")
        spark.conf.set("spark.sql.ansi.enabled", str(a.dialect == "ansi").lower())
        layer = tables.as_layer(spark.sql(a.sql))
    rasters, masks = read_rasters(spark, a.raster), read_rasters(spark, a.mask)
    if masks and len(masks) != len(rasters):
        rasters, masks = map(list, zip(*tables.pair_masks(rasters, masks)))
    o = options(a)
    if a.validate_inputs:
        checked = extract.validate_inputs(tables.raster_list(spark, [g for g, _ in rasters + masks])).first()
        if not checked.ok:
            raise ValueError(f"inputs differ: same reference system {checked.same_srs}, same pixel size {checked.same_pixel_size}")
    name = lambda suffix: f"{a.out_prefix}{suffix}"
    if a.show_fields:
        report.fields_of({a.layer or "layer": layer}).orderBy("position").show(10_000, truncate=False)
    if a.report or a.out_type == "report":
        reports(a, spark, layer, rasters, a.out or name("_report"))
    if a.dump_geometries:
        put(dump(layer, rasters, o).select("line"), a.dump_geometries, a.delimiter)
    if a.jtstest:
        cells = x.cells_of(layer, x.Rasters.of(rasters[:1]), o)
        put(report.intersect_cases(cells, layer, rasters[0][0]).orderBy("fid", "block").select("xml"), a.jtstest, "\x01")
    if a.calibrate:
        path, link = a.calibrate
        lib = tables.read_delimited(spark, path, a.delimiter)
        st = x.statistics(layer, rasters, replace(o, fields=[link]), masks)
        bands = [c for c in rasters[0][1].columns if c.startswith("band")]
        put(legacy.calibration(lib, st, link, bands, list(o.stats)), a.out or name("_calibration.csv"), a.delimiter)
    want = lambda kind, suffix: name(suffix) if suffix is not None and a.out_type in (None, "table", kind) else a.out if a.out and a.out_type == kind else None
    if path := want("table", a.table_suffix):
        put(x.table(layer, rasters, o, masks, ordered=True), path, a.delimiter)
    if path := want("stats", a.summary_suffix):
        out = x.statistics(layer, rasters, o, masks).orderBy("rid", "fid")
        put(sinks.stats_text(out), path, a.delimiter)
    if path := want("classes", a.class_summary_suffix):
        put(x.classes(layer, rasters, o, masks=masks).orderBy("rid", "fid", "class"), path, a.delimiter)
    if a.out_type == "mini_rasters":
        images(a, layer, rasters, masks, o)
    if a.out_type == "mini_raster_strip":
        strips(a, layer, rasters, masks, o)
    if a.out_type == "rasterize" or a.rasterize_suffix is not None:
        burned(a, layer, rasters, o)


def reports(a, spark, layer, rasters, out: str) -> None:
    if rasters:
        bands = len([c for c in rasters[0][1].columns if c.startswith("band")])
        report.raster_report(tables.raster_list(spark, [g for g, _ in rasters], bands)).write.mode("overwrite").json(f"{out}/rasters")
    if layer is not None:
        report.fields_of({"layer": layer}).write.mode("overwrite").json(f"{out}/fields")
        if "wkt" in layer.columns:
            report.geometry_counters(layer).write.mode("overwrite").json(f"{out}/geometries")


def _rasters_for(rasters, o):
    return x.Rasters.of(rasters) if o.chooses else x.stacked(rasters)


def images(a, layer, rasters, masks, o) -> None:
    """Cut-outs: images named by prefix, fid and suffix, or windows and pixels as tables under ``--out``."""
    r = _rasters_for(rasters, o)
    windows, px = x.mini_rasters(layer, r, o, (a.out + "/") if a.out else a.out_prefix, masks, a.mr_img_suffix or ".img")
    if a.out:
        windows.write.mode("overwrite").parquet(f"{a.out}/windows")
        px.write.mode("overwrite").parquet(f"{a.out}/pixels")
    else:
        sinks.write_cutouts(windows, px, r.table, r.bands, srs=a.srs)


def strips(a, layer, rasters, masks, o) -> None:
    """A strip: three images and a shapefile named by prefix and suffixes, or tables under ``--out``."""
    r = _rasters_for(rasters, o)
    layout, full, moved = x.strip(layer, r, o, masks)
    if a.out:
        for part, df in (("layout", layout), ("strip", full), ("vector", moved)):
            df.write.mode("overwrite").parquet(f"{a.out}/{part}")
        return
    base = a.out_prefix
    sinks.write_strip(layout, full, r.bands, base + (a.mrst_img_suffix or "_mr.img"), base + a.mrst_fid_suffix, base + a.mrst_glt_suffix, o.nodata or 0.0)
    if a.mrst_shp_suffix is not None:
        sinks.write_shapefile(moved, base + a.mrst_shp_suffix)


def burned(a, layer, rasters, o) -> None:
    out = x.rasterized(layer, rasters, o, a.value)
    if a.rasterize_suffix is None:
        out.write.mode("overwrite").parquet(a.out)
        return
    g = replace(rasters[0][0], nodata=o.nodata if o.nodata is not None else rasters[0][0].nodata)
    sinks.write_envi(out, g, ["value"], f"{a.out_prefix}{a.rasterize_suffix}", 1 if 0 <= a.value <= 255 else 2, g.nodata or 0)


#: Parameters of the commands and the options they stand for.
COMMANDS = {
    "report": {"vector": "--vector", "rasters": "--raster", "output": "--out"},
    "csv": {"vector": "--vector", "rasters": "--raster", "masks": "--mask", "output": "--table-suffix", "fields": "--fields", "duplicate_pixel": "--duplicate", "layer": "--layer", "delimiter": "--delimiter"},
    "rasterize": {"vector": "--vector", "rasters": "--raster", "output": "--rasterize-suffix", "layer": "--layer", "value": "--value"},
}


def command(words: list[str]) -> list[str]:
    """The options that a command's ``name=value`` parameters stand for; lists are separated by commas."""
    known, out = COMMANDS[words[0]], {"report": ["--report"], "csv": ["--out-type", "table"], "rasterize": ["--out-type", "rasterize"]}[words[0]]
    given = dict(w.split("=", 1) for w in words[1:])
    if unknown := set(given) - set(known):
        raise ValueError(f"{words[0]}: unknown parameters {sorted(unknown)}")
    if words[0] != "report" and not {"vector", "rasters", "output"} <= set(given):
        raise ValueError(f"{words[0]} needs vector, rasters and output")
    if words[0] == "report" and not {"vector", "rasters"} & set(given):
        raise ValueError("report needs a vector map or raster maps")
    if "masks" in given and given["masks"].count(",") != given["rasters"].count(","):
        raise ValueError("as many masks as rasters")
    for n, v in given.items():
        values = [v] if n in ("delimiter", "output") else [w for part in v.split(",") for w in (part.split() if n == "duplicate_pixel" else [part])]
        out += [known[n], *values]
    return out


def arguments(words: list[str]) -> argparse.Namespace:
    return parser().parse_args(command(words) if words and words[0] in COMMANDS else words)


if __name__ == "__main__":
    run(arguments(sys.argv[1:]), SparkSession.builder.getOrCreate())
