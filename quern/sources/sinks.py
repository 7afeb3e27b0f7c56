"""Writers: delimited text, ENVI rasters, cut-outs and strips, shapefiles, pixel tables.

Formats of one file are made of lines or images that executors encode; the driver only puts them in
their place, one at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.geom import parse_wkt
from quern.functions.grid import Grid
from quern.functions.wkb import shape_file, table_file
from quern.operators.cutout import strip_size
from quern.operators.extract import tiled
from quern.sources.tables import ENVI_TYPES

#: ENVI data type that holds a Spark type.
ENVI_OF = {"tinyint": 2, "smallint": 2, "int": 3, "bigint": 5, "float": 4, "double": 5}


def write_table(df: DataFrame, path: str, sep: str = ",", append: bool = True) -> None:
    """Part files with a header each: the distributed sink. An order that ``df`` has is that of its parts."""
    df.write.mode("append" if append else "overwrite").options(sep=sep, header="true", quote='"', escape='"').csv(path)


def delimited_lines(df: DataFrame, sep: str) -> DataFrame:
    """One text column: fields joined by ``sep``; a field is quoted only if it contains it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = [F.when(F.instr(text(f"`{c}`"), sep) > 0, F.concat(F.lit('"'), text(f"`{c}`"), F.lit('"'))).otherwise(text(f"`{c}`")) for c in df.columns]
    return df.select(F.concat_ws(sep, *fields).alias("line"))


def append_file(df: DataFrame, path: str, sep: str = ",") -> int:
    """One local file, made with a header or appended to (a missing final newline is repaired). Lines are made by executors and streamed."""
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    ended, n = True, 0
    if not new:
        with open(path, "rb") as f:
            f.seek(-1, 2)
            ended = f.read(1) == b"\n"
    with open(path, "a", encoding="utf-8", newline="") as f:
        if new:
            f.write(sep.join(f'"{c}"' if sep in c else c for c in df.columns) + "\n")
        elif not ended:
            f.write("\n")
        for row in delimited_lines(df, sep).toLocalIterator(prefetchPartitions=True):
            f.write(row.line + "\n")
            n += 1
    return n


def stats_text(df: DataFrame) -> DataFrame:
    """Statistics as text: six decimals for doubles, whole numbers as they are."""
    return df.select(*(F.format_string("%f", c).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def envi_header(g: Grid, bands: int, data_type: int, interleave: str = "bsq") -> str:
    """Header text. Coordinates have six decimals; the reference system's words are those of ``srs`` if it is a list of them."""
    words = g.srs.split(",") if g.srs and "[" not in g.srs else ["Arbitrary"]
    info = [words[0], "1", "1", *(f"{v:.6f}" for v in (g.x0, g.y0, abs(g.px), abs(g.py))), *words[1:]]
    lines = ["ENVI", f"samples = {g.width}", f"lines   = {g.height}", f"bands   = {bands}", "header offset = 0", "file type = ENVI Standard", f"data type = {data_type}", f"interleave = {interleave}", "byte order = 0"]
    lines.append("map info = {" + ", ".join(x.strip() for x in info) + "}")
    if "[" in g.srs:
        lines.append(f"coordinate system string = {{{g.srs}}}")
    if g.nodata is not None:
        lines.append(f"data ignore value = {g.nodata!r}")
    lines.append("band names = {\n" + ",\n".join(f"Band {k + 1}" for k in range(bands)) + "}")
    return "\n".join(lines) + "\n"


def _stem(path: str) -> str:
    return path[: -len(".img")] if path.endswith(".img") else path


def encoded_lines(pixels: DataFrame, bands: list[str], width: int, kind: str, fill: float, row: str = "row", col: str = "col") -> DataFrame:
    """(row, line): each line of a raster with all bands one behind the other, encoded by the task that holds it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(bands), width), fill, dtype="<" + kind)
        for k, b in enumerate(bands):
            v = part[b].to_numpy(dtype="float64", na_value=np.nan)
            own = ~np.isnan(v) if kind[0] != "f" else part[b].notna().to_numpy()
            out[k, part[col].to_numpy()[own]] = v[own]
        return pd.DataFrame({"row": [int(part[row].iloc[0])], "line": [out.tobytes()]})

    return pixels.select(row, col, *bands).groupBy(row).applyInPandas(run, "row long, line binary")


def write_envi(pixels: DataFrame, g: Grid, bands: list[str], path: str, data_type: int = 4, fill: float = 0.0, row: str = "row", col: str = "col") -> None:
    """A local ENVI file (BSQ) and its header; encoded lines stream into a memory-mapped file, so size is bounded by disk."""
    kind = ENVI_TYPES[data_type][0]
    out = np.memmap(path, dtype="<" + kind, mode="w+", shape=(len(bands), g.height, g.width))
    out[:] = fill
    for r in encoded_lines(pixels, bands, g.width, kind, fill, row, col).toLocalIterator(prefetchPartitions=True):
        out[:, r.row, :] = np.frombuffer(r.line, dtype="<" + kind).reshape(len(bands), g.width)
    out.flush()
    with open(f"{_stem(path)}.hdr", "w") as f:
        f.write(envi_header(g, len(bands), data_type))


def envi_images(windows: DataFrame, pixels: DataFrame, rasters: DataFrame, bands: list[str], data_type: int, srs: str | None = None) -> DataFrame:
    """(name, header, image): an ENVI image of each window, encoded by executors. ``pixels``: (fid, rid, c, r, bands)."""
    kind = ENVI_TYPES[data_type][0]
    grid = windows.join(rasters.select("rid", "px", "py", F.lit(srs).alias("srs") if srs is not None else "srs", "nodata"), "rid")

    def run(key, own: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"name": [], "header": [], "image": []})
        w = own.iloc[0]
        out = np.zeros((len(bands), int(w.height), int(w.width)), dtype="<" + kind)
        for k, b in enumerate(bands):
            out[k, px["r"], px["c"]] = px[b]
        nodata = None if pd.isna(w.nodata) else float(w.nodata)
        g = Grid(int(w.width), int(w.height), float(w.ulx), float(w.uly), float(w.px), float(w.py), srs=w.srs or "", nodata=nodata)
        return pd.DataFrame({"name": [w["name"]], "header": [envi_header(g, len(bands), data_type)], "image": [out.tobytes()]})

    apart = pixels.select(*(F.col(c).alias(c) for c in pixels.columns))  # both sides come from the same cells
    return grid.groupBy("fid", "rid").cogroup(apart.groupBy("fid", "rid")).applyInPandas(run, "name string, header string, image binary")


def write_cutouts(windows: DataFrame, pixels: DataFrame, rasters: DataFrame, bands: list[str], folder: str = "", srs: str | None = None) -> int:
    """Local ``.img`` and ``.hdr`` files of all cut-outs, named as the windows say; the driver holds one image at a time."""
    data_type = max(ENVI_OF[k] for c, k in pixels.dtypes if c in bands)
    n = 0
    for r in envi_images(windows, pixels, rasters, bands, data_type, srs).toLocalIterator():
        path = os.path.join(folder, r.name)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "wb") as f:
            f.write(r.image)
        with open(f"{_stem(path)}.hdr", "w") as f:
            f.write(r.header)
        n += 1
    return n


def write_strip(layout: DataFrame, strip: DataFrame, bands: list[str], data: str, fids: str, places: str, fill: float = 0.0) -> tuple[int, int]:
    """The three local images of a strip: bands, fids (-1 where none) and locations (two bands of float32). Returns width and height."""
    width, height = (int(v or 0) for v in strip_size(layout).first())
    g = Grid(width, height, 0.0, 0.0, 1.0, -1.0, srs="Unknown,0,North")
    if width and height:
        kind = max(ENVI_OF[k] for c, k in strip.dtypes if c in bands)
        covered = strip.where("fid <> -1")
        for path, own, data_type, other in ((data, bands, kind, fill), (fids, ["fid"], 3, -1), (places, ["x", "y"], 4, 0.0)):
            write_envi(covered, g, own, path, data_type, other, "strip_row", "strip_col")
    return width, height


#: Shape codes of kinds of geometry. Fixed values of the format.
SHAPES = {"POINT": 1, "LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5, "MULTIPOLYGON": 5}


def write_shapefile(features: DataFrame, path: str) -> int:
    """Local ``.shp``, ``.shx`` and ``.dbf`` of features in order of fid (of one kind of geometry, that of the first). The format bounds its size."""
    attrs = [c for c in features.columns if c not in ("fid", "wkt", "minx", "miny", "maxx", "maxy")]
    kinds = dict(features.dtypes)
    shapes, rows, code = [], [], None
    for r in features.where("wkt is not null").orderBy("fid").toLocalIterator():
        g = parse_wkt(r.wkt)
        if not g[1]:
            continue
        own = SHAPES.get(g[0])
        code = code or own
        if own != code:
            raise ValueError(f"a shapefile has one kind of geometry: {g[0]} among others")
        shapes.append((len(shapes), g))
        rows.append(tuple(r[c] for c in attrs))
    shp, shx = shape_file(shapes, code or 1)
    for suffix, content in ((".shp", shp), (".shx", shx), (".dbf", table_file([(c, kinds[c]) for c in attrs], rows))):
        with open(path.removesuffix(".shp") + suffix, "wb") as f:
            f.write(content)
    return len(rows)


def write_spectra(spectra: DataFrame, path: str, fields: list[str] = (), data_type: int = 5, library: bool = True) -> int:
    """A local ENVI spectral library (or an image of one column) of ``spectra(name, spectrum, fields)`` in order of name, and a ``.ser`` file a field.

    Spectra stream, so size is bounded by disk; names go to the header of a library, fields to files of a line a spectrum.
    """
    kind, stem = "<" + ENVI_TYPES[data_type][0], os.path.splitext(path)[0]
    n, width, names = 0, 0, f"{stem}.names"
    series = {f: open(f"{stem}_{f}.ser", "w", encoding="utf-8") for f in fields}
    try:
        with open(path, "wb") as out, open(names, "w", encoding="utf-8") as own:
            for r in spectra.orderBy("name").toLocalIterator(prefetchPartitions=True):
                out.write(np.asarray(r.spectrum, dtype=kind).tobytes())
                own.write(r.name + "\n")
                n, width = n + 1, len(r.spectrum)
                for f, file in series.items():
                    file.write(("" if r[f] is None else str(r[f])) + "\n")
    finally:
        for file in series.values():
            file.close()
    with open(f"{stem}.hdr", "w", encoding="utf-8") as head, open(names, encoding="utf-8") as own:
        size = (width, n, 1) if library else (1, n, width)
        head.write("ENVI\n" + "".join(f"{k} = {v}\n" for k, v in zip(("samples", "lines  ", "bands  "), size)))
        head.write(f"header offset = 0\nfile type = ENVI {'Spectral Library' if library else 'Standard'}\ndata type = {data_type}\ninterleave = {'bsq' if library else 'bip'}\nbyte order = 0\n")
        if library:
            head.write("spectra names = {\n")
            for k, line in enumerate(own):
                head.write((",\n" if k else "") + line.rstrip("\n"))
            head.write("}\n")
    os.remove(names)
    return n


def write_pixels(pixels: DataFrame, path: str, tile: int | None = None) -> None:
    """The pixel table, by raster and, if ``tile`` is given, by square of that many cells: reads of some prune the rest."""
    keys = ["rid"] if tile is None else ["rid", "tile"]
    out = pixels if tile is None else tiled(pixels, tile)
    out.repartition(*keys).sortWithinPartitions(*keys, "row", "col").write.mode("overwrite").partitionBy(*keys).parquet(path)


def each_group(df: DataFrame, keys: list[str], observe: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of the user's own over the pixels of each feature: what an observer of the traversal would do.

    ``observe(key, pixels)`` gets the key and the rows of one group and returns rows of ``schema``. A function that
    needs locations alone should be given a frame without bands: then none are read.
    """
    return df.groupBy(*keys).applyInPandas(lambda key, part: observe(key, part), schema)
