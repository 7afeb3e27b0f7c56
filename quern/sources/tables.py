"""Readers: layers (tables, WKB, shapefiles), rasters (pixel tables and ENVI files), delimited text, lists of rasters and masks."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, _parse_datatype_string

from quern.functions.geom import to_wkt
from quern.functions.grid import Grid
from quern.functions.wkb import shape_records, table_records, wkb_to_wkt
from quern.operators.rasterize import with_bounds

#: ENVI data type codes: numpy type and the Spark type that holds it. Fixed values of the format.
ENVI_TYPES = {1: ("u1", "smallint"), 2: ("i2", "smallint"), 3: ("i4", "int"), 4: ("f4", "float"), 5: ("f8", "double"), 12: ("u2", "int"), 13: ("u4", "bigint")}


def layer(spark: SparkSession, path: str, kind: str | None = None, name: str | None = None, **options) -> DataFrame:
    """A vector layer with a ``fid`` from Parquet, CSV, JSON or a shapefile: ``wkt``, ``wkb`` or x and y.

    ``name``: which layer of a folder of layers (a file or folder of that name, with any ending), else the
    first in order. A view or table of the catalog is found by its name.
    """
    if spark.catalog.tableExists(path) if re.fullmatch(r"[A-Za-z_]\w*(\.\w+)*", path) else False:
        return as_layer(spark.table(path))
    if name is not None or _is_folder_of_layers(spark, path):
        path = _layer_path(spark, path, name)
        kind = None
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "shp":
        return shapefile(spark, path)
    df = spark.read.options(**({"header": "true", "inferSchema": "true"} if kind == "csv" else {}) | options).format(kind).load(path)
    return as_layer(df)


def as_layer(df: DataFrame) -> DataFrame:
    """A table with ``fid`` as a layer: geometry as WKT, and its bounds."""
    if "fid" not in df.columns:
        raise ValueError("a layer needs a fid column")
    if "wkt" not in df.columns and "wkb" in df.columns:
        df = df.withColumn("wkt", _from_wkb("wkb")).drop("wkb")
    if "wkt" in df.columns:
        return df if "minx" in df.columns else with_bounds(df)
    if {"x", "y"} <= set(df.columns):
        point = F.concat(F.lit("POINT ("), F.col("x").cast("double").cast("string"), F.lit(" "), F.col("y").cast("double").cast("string"), F.lit(")"))
        return df.withColumns({"wkt": F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), point), "minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")})
    return df


@F.pandas_udf(StringType())
def _from_wkb(data: pd.Series) -> pd.Series:
    return data.map(wkb_to_wkt).astype(object)


def _listed(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in fs.listStatus(p)) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []


BOUNDS = ("minx", "miny", "maxx", "maxy")
LAYERS = (".parquet", ".csv", ".json", ".shp")


def _is_folder_of_layers(spark: SparkSession, path: str) -> bool:
    return not path.rstrip("/").endswith(LAYERS) and any(x.endswith(LAYERS) and not x.rsplit("/", 1)[-1].startswith("part-") for x in _listed(spark, path))


def _layer_path(spark: SparkSession, path: str, name: str | None) -> str:
    found = [x for x in _listed(spark, path) if x.endswith(LAYERS)]
    own = [x for x in found if name is not None and x.rsplit("/", 1)[-1].rsplit(".", 1)[0] == name]
    return (own or found or [path])[0]  # an unknown name falls back to the first layer


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of a ``.shp`` file (fid from 0) with the columns of its ``.dbf``.

    Each file is read by one task, as the format has no other way in; its features are dealt out behind it.
    """
    stem = path[: -len(".shp")]

    def shapes(batches):
        for batch in batches:
            for (content,) in zip(batch.column(0).to_pylist()):
                rows = [(k, None if g is None else to_wkt(g)) for k, g in shape_records(content)]
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string())], names=["fid", "wkt"])

    read = lambda p: spark.read.format("binaryFile").load(p).select("content")
    out = read(path).mapInArrow(shapes, "fid long, wkt string")
    names = {x.rsplit("/", 1)[-1] for x in _listed(spark, path.rsplit("/", 1)[0] if "/" in path else ".")}
    if f"{stem.rsplit('/', 1)[-1]}.dbf" in names:
        columns, _ = table_records(_first_bytes(spark, f"{stem}.dbf"))
        keep = [k for k, (n, _) in enumerate(columns) if n.lower() not in ("fid", "wkt", *BOUNDS)]
        columns = [columns[k] for k in keep]
        schema = "fid long" + "".join(f", `{n}` {k}" for n, k in columns)
        arrow = to_arrow_schema(_parse_datatype_string(schema))

        def rows_of(batches):
            for batch in batches:
                for (content,) in zip(batch.column(0).to_pylist()):
                    rows = [(k, *(r[c] for c in keep)) for k, r in enumerate(table_records(content)[1]) if r is not None]
                    for at in range(0, len(rows), 1024):
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 1024]), arrow)], schema=arrow)

        out = out.join(read(f"{stem}.dbf").mapInArrow(rows_of, schema), "fid")
    return with_bounds(out)


def _first_bytes(spark: SparkSession, path: str) -> bytes:
    """Header of a ``.dbf`` file (columns only: the count of rows is set to 0)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        head = bytes(stream.readNBytes(12))
        size = int.from_bytes(head[8:10], "little")
        return head[:4] + bytes(4) + head[8:] + bytes(stream.readNBytes(size - 12))
    finally:
        stream.close()


def choose_layer(layers: dict[str, DataFrame], name: str | None = None) -> DataFrame:
    """A layer by name; the first one if the name is unknown or not given."""
    return layers.get(name, next(iter(layers.values())))


def resolve(spark: SparkSession, name: str) -> DataFrame:
    """A view or table of that name, else a Parquet path."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(name)


def sql_layer(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """Result of a SQL statement over registered layers."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited text table, all columns strings. ``sep``: a set of characters; quoted fields may hold them.

    Of several files the first line of each is its header. Rows may be shorter or longer than the header:
    what is missing is null, what is beyond it is left out.
    """
    if len(sep) == 1:
        return spark.read.options(sep=sep, header=header, quote='"', escape='"').csv(path)
    one = "[" + re.escape(sep) + "]"
    # fields are quoted or free of separators; an odd number of quotes before a separator means that it is inside some
    parts = F.transform(F.split("value", f'{one}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.regexp_replace(F.regexp_replace(x, '^"(.*)"$', "$1"), '""', '"'))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    if header:
        first = Window.partitionBy("file").orderBy("at", "n")
        heads = lines.where("at = 0").withColumn("k", F.row_number().over(first)).where("k = 1").select("file", "n")
        names = [str(x) for x in lines.where("at = 0").orderBy("file", "n").select(parts.alias("p")).first()["p"]]
        lines = lines.join(F.broadcast(heads) if heads.limit(10_001).count() <= 10_000 else heads, ["file", "n"], "left_anti")
        n = len(names)
    else:
        n = lines.select(F.max(F.size(parts))).first()[0] or 0
        names = [f"_c{k}" for k in range(n)]
    return lines.select(parts.alias("p")).select(*(F.get("p", F.lit(k)).alias(names[k]) for k in range(n)))


def parse_envi_header(text: str) -> dict[str, str]:
    """Keys (lower case) and values of an ENVI header; braces may span lines."""
    body = re.sub(r"\{([^}]*)\}", lambda m: "{" + " ".join(m[1].split()) + "}", text)
    pairs = (line.split("=", 1) for line in body.splitlines() if "=" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def envi_grid(header: dict[str, str], rid: str = "raster") -> Grid:
    """The grid of a header. The map reference is a pixel counted from 1, its upper-left corner; ``rotation=`` turns it (degrees)."""
    info = [x.strip() for x in header.get("map info", "{x, 1, 1, 0, 0, 1, 1}").strip("{}").split(",")]
    rx, ry, x, y, px, py = (float(v) for v in info[1:7])
    turn = next((math.radians(float(v.split("=")[1])) for v in info if v.lower().replace(" ", "").startswith("rotation=")), 0.0)
    g1, g2, g4, g5 = px * math.cos(turn), py * math.sin(turn), px * math.sin(turn), -py * math.cos(turn)
    if not turn:
        g1, g2, g4, g5 = px, 0.0, 0.0, -py
    nodata = header.get("data ignore value")
    srs = header.get("projection info", header.get("coordinate system string", ",".join([info[0], *info[7:]]) if "map info" in header else ""))
    return Grid(
        int(header["samples"]), int(header["lines"]), x - (rx - 1) * g1 - (ry - 1) * g2, y - (rx - 1) * g4 - (ry - 1) * g5, g1, g5, rid, srs, float(nodata) if nodata else None, (g2, g4),
    )


def read_envi(spark: SparkSession, path: str, header: str, rid: str | None = None) -> tuple[DataFrame, Grid]:
    """Pixels (rid, col, row, band1...) and grid of an ENVI file.

    The file is read by Spark as fixed-length records: a line of all bands (BIP, BIL), so that pixels leave
    the task that reads their line, or of one band (BSQ), whose lines (not pixels) are exchanged by row. A
    raster of any size is split over tasks. A header inside the file must be a whole number of records.
    """
    h = parse_envi_header("\n".join(r.value for r in spark.read.text(header).collect()))
    rid = rid or path.rsplit("/", 1)[-1]
    g, n_bands = envi_grid(h, rid), int(h["bands"])
    kind, sql = ENVI_TYPES[int(h["data type"])]
    kind = (">" if h.get("byte order", "0") == "1" else "<") + kind
    layout, width, height, size = h.get("interleave", "bsq").lower(), g.width, g.height, np.dtype(kind).itemsize
    per = width * size * (1 if layout == "bsq" else n_bands)
    skip, rest = divmod(int(h.get("header offset", "0")), per)
    if rest:
        raise ValueError("a header inside the data file must be as long as some of its lines")
    lines = spark.createDataFrame(spark.sparkContext.binaryRecords(path, per).zipWithIndex().map(lambda x: (x[1], bytearray(x[0]))), "n long, line binary")
    lines = lines.where((F.col("n") >= skip) & (F.col("n") < skip + height * (n_bands if layout == "bsq" else 1))).withColumn("n", F.col("n") - skip)
    if layout == "bsq":
        by_row = lines.groupBy((F.col("n") % height).cast("int").alias("row")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("b"))
        lines = by_row.select("row", F.transform("b", lambda x: x.line).alias("lines"))
    else:
        lines = lines.select(F.col("n").cast("int").alias("row"), F.array("line").alias("lines"))
    names = [f"band{k + 1}" for k in range(n_bands)]
    schema = "rid string, col int, row int, " + ", ".join(f"{n} {sql}" for n in names)

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for row, parts in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(b"".join(parts), dtype=kind).astype(kind[1:])
                v = v.reshape(width, n_bands).T if layout == "bip" else v.reshape(n_bands, width)
                cols = [pa.array([rid] * width), pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, row, np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(b)).cast(arrow.field(n).type) for b, n in zip(v, names))], schema=arrow)

    return lines.mapInArrow(run, schema), g


def raster_list(spark: SparkSession, grids: list[Grid], bands: int = 1) -> DataFrame:
    """``rasters(idx, rid, path, width, height, bands, x0, y0, px, py, srs, nodata)`` of grids in list order. Joins send it to every task: it came from the driver, and features that met it by tile would be few tasks' work."""
    rows = [(k, g.rid, g.rid, g.width, g.height, bands, g.x0, g.y0, g.px, g.py, g.srs, g.nodata) for k, g in enumerate(grids)]
    return F.broadcast(spark.createDataFrame(rows, "idx int, rid string, path string, width int, height int, bands int, x0 double, y0 double, px double, py double, srs string, nodata double"))


def pair_masks(rasters: list, masks: list) -> list[tuple]:
    """Rasters and masks by place, as many as the shorter list has."""
    return list(zip(rasters, masks))
