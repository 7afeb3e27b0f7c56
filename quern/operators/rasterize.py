"""From features to grid cells: (fid, part, col, row). The spatial join becomes an equi-join on cells.

Points, boxes and segments with their own coordinate columns stay in generated JVM code; geometries
given as WKT go through one Arrow function that returns row spans, so that what Python makes follows
the perimeter of a polygon and the cells are exploded on the JVM side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.geom import (
    EPS, buffered, clipped, envelope, leaves, line_cells, parse_wkt, polygon_is_valid, polygon_spans, rectangle, rectangle_spans, repaired, segment_cells, to_wkt,
)
from quern.functions.grid import Grid, col_of, dbl, in_envelope, on_grid, row_of


def dealt(features: DataFrame) -> DataFrame:
    """``features`` dealt to tasks by fid, those of one fid to the same one.

    Features are few bytes, read by few tasks, and many cells or much work: what follows would be the work of those tasks.
    """
    return features.repartition("fid")


def segments_to_distinct_cells(segments: DataFrame, g: Grid) -> DataFrame:
    """(fid, col, row), each cell of a feature once.

    A segment has no cell twice, so only the cells of features of several segments are compared. The number of
    partitions is given: the exchange holds a small part of what the cells will be, and would make few of them.
    """
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = segments.repartition(n, "fid").withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy("fid")))
    one, more = (segments_to_cells(counted.where(c), g).select("fid", "col", "row") for c in ("__of = 1", "__of > 1"))
    return one.unionByName(more.dropDuplicates())


def points_to_cells(features: DataFrame, g: Grid, x: str = "x", y: str = "y", edge_mode: str = "reference") -> DataFrame:
    """``features`` with col and row, for points inside the raster."""
    out = features.where(in_envelope(x, y, g, edge_mode)).withColumn("col", col_of(x, g)).withColumn("row", row_of(y, g))
    return out.where(on_grid("col", "row", g))


def box_columns(features: DataFrame, width, height=None) -> DataFrame:
    """Bounding box columns replaced by a box of the given size (numbers or columns) about their centre."""
    w, h = (F.abs(x if isinstance(x, Column) else F.lit(float(x))) for x in (width, width if height is None else height))
    cx, cy = (dbl("minx") + dbl("maxx")) / F.lit(2.0), (dbl("miny") + dbl("maxy")) / F.lit(2.0)
    return features.withColumns({"minx": cx - w / 2, "maxx": cx + w / 2, "miny": cy - h / 2, "maxy": cy + h / 2})


def boxes_to_cells(features: DataFrame, g: Grid, pixprop: float = 0.5, edge_mode: str = "reference") -> DataFrame:
    """``features`` (minx..maxy) with col, row and coverage, for cells covered to ``pixprop`` at least.

    The candidate cells are a sequence over the clipped box; coverage is a product of overlaps.
    """
    check_pixprop(pixprop)
    a, b, c, d = g.envelope(edge_mode)
    f = features.withColumns(
        {
            "__x0": F.greatest(dbl("minx"), dbl(a)), "__x1": F.least(dbl("maxx"), dbl(c)),
            "__y0": F.greatest(dbl("miny"), dbl(b)), "__y1": F.least(dbl("maxy"), dbl(d)),
        }
    ).where("__x0 < __x1 and __y0 < __y1")
    u = lambda v: (dbl(v) - dbl(g.x0)) / dbl(g.px)
    w = lambda v: (dbl(v) - dbl(g.y0)) / dbl(g.py)
    f = f.withColumns(
        {"__u0": F.least(u("__x0"), u("__x1")), "__u1": F.greatest(u("__x0"), u("__x1")), "__v0": F.least(w("__y0"), w("__y1")), "__v1": F.greatest(w("__y0"), w("__y1"))}
    )
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int")))
    f = f.withColumn("row", cells(F.col("__v0"), F.col("__v1"))).withColumn("col", cells(F.col("__u0"), F.col("__u1")))
    share = lambda lo, hi, k: F.least(F.col(hi), dbl(k) + F.lit(1.0)) - F.greatest(F.col(lo), dbl(k))
    f = f.withColumn("coverage", share("__u0", "__u1", "col") * share("__v0", "__v1", "row"))
    f = f.where(F.col("coverage") > EPS if pixprop == 0 else F.col("coverage") >= F.lit(float(pixprop) - EPS))
    return f.where(on_grid("col", "row", g)).drop(*(f"__{n}" for n in ("x0", "x1", "y0", "y1", "u0", "u1", "v0", "v1")))


def segments_to_cells(segments: DataFrame, g: Grid, ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), last: str | bool = True) -> DataFrame:
    """``segments`` with col and row: one cell a step of the longer axis, in closed form."""
    fixed = lambda v, origin, size: F.rint(F.lit(256.0) * ((dbl(v) - dbl(origin)) / dbl(size))).cast("long")
    x1, y1, x2, y2 = ends
    f = segments.withColumns(
        {"__x1": fixed(x1, g.x0, g.px), "__y1": fixed(y1, g.y0, g.py), "__x2": fixed(x2, g.x0, g.px), "__y2": fixed(y2, g.y0, g.py)}
    ).withColumn("__last", F.lit(last).cast("int") if isinstance(last, bool) else F.col(last).cast("int"))
    cell = lambda c: F.shiftright(F.col(c), 8)
    dc, dr = F.abs(cell("__x2") - cell("__x1")), F.abs(cell("__y2") - cell("__y1"))
    f = f.withColumns({"__steep": dc < dr, "__n": F.greatest(dc, dr)})
    steep = F.col("__steep")
    f = f.withColumns(
        {
            "__a": F.when(steep, F.col("__x1")).otherwise(F.col("__y1")), "__b": F.when(steep, F.col("__x2")).otherwise(F.col("__y2")),
            "__lead": F.when(steep, cell("__y1")).otherwise(cell("__x1")),
            "__step": F.when(F.when(steep, F.col("__y2") > F.col("__y1")).otherwise(F.col("__x2") > F.col("__x1")), 1).otherwise(-1),
        }
    ).where((F.col("__n") > 0) | (F.col("__last") == 1))
    n = F.greatest(F.col("__n"), F.lit(1))
    f = f.withColumn("__whole", F.ceil((F.col("__b") - F.col("__a")).cast("double") / n) - 1)
    f = f.withColumn("__rest", F.col("__b") - F.col("__a") - F.col("__whole") * n)
    f = f.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__n") + F.col("__last") - 1, F.lit(0)))))
    across = F.shiftright(
        F.col("__a") + F.col("__k") * F.col("__whole") + F.ceil((F.col("__k") + 1).cast("double") * F.col("__rest") / n) - 1, 8
    )
    across = F.when(F.col("__n") == 0, F.shiftright(F.col("__a"), 8)).otherwise(across)
    along = F.col("__lead") + F.col("__step") * F.col("__k")
    f = f.withColumns({"col": F.when(steep, across).otherwise(along).cast("int"), "row": F.when(steep, along).otherwise(across).cast("int")})
    return f.where(on_grid("col", "row", g)).drop(*(c for c in f.columns if c.startswith("__")))


def check_pixprop(p: float) -> None:
    if not 0 <= p <= 1:
        raise ValueError("pixprop must be in [0, 1]")


#: What the span function reads of a raster, and what it returns.
GRID = ("width", "height", "x0", "y0", "px", "py")
SPANS = "fid long, rid string, part int, kind string, row int, col_from int, col_to int"


def _spans(g: Grid, pixprop: float, edge_mode: str, skip_invalid: bool):
    """WKT -> (part, kind, row, first col, last col). Points and lines give a cell once; parts of polygons may share cells."""
    box = g.envelope(edge_mode)

    def unit(p):
        return (p[0] - g.x0) / g.px, (p[1] - g.y0) / g.py

    def of(geometry) -> list[tuple[int, str, int, int, int]]:
        out, seen = [], set()
        if geometry[0] == "RECTANGLE":
            a, b, c, d = geometry[1]
            a, b, c, d = max(a, box[0]), max(b, box[1]), min(c, box[2]), min(d, box[3])
            if a >= c or b >= d:
                return out
            (u0, v0), (u1, v1) = unit((a, b)), unit((c, d))
            return [(0, "POLYGON", *x) for x in rectangle_spans(min(u0, u1), min(v0, v1), max(u0, u1), max(v0, v1), pixprop, g.width, g.height)]
        for part, (kind, (shape,)) in enumerate(leaves(clipped(geometry, box))):
            if kind == "POLYGON":
                cells = polygon_spans([[unit(p) for p in ring] for ring in shape], pixprop, g.width, g.height)
            else:
                if kind == "POINT":
                    u, v = unit(shape)
                    hit = [(int(u // 1), int(v // 1))]
                else:
                    rel, hit = [(x - g.x0, y - g.y0) for x, y in shape], []
                    for k, (p, q) in enumerate(zip(rel, rel[1:])):
                        hit += line_cells(p, q, g.px, g.py, k == len(rel) - 2)
                cells = [(r, c, c) for c, r in dict.fromkeys(hit) if (c, r) not in seen]
                seen.update(hit)
            out += [(part, kind, r, max(a, 0), min(b, g.width - 1)) for r, a, b in cells if 0 <= r < g.height and b >= 0 and a < g.width]
        return out

    return of


def repairable(geometry, skip_invalid: bool = False):
    """The geometry with invalid polygons repaired, or left out; a rectangle along the axes as such."""
    if geometry[0] == "POLYGON" and geometry[1] and (bounds := rectangle(geometry[1][0])):
        return ("RECTANGLE", bounds)
    out = []
    for kind, (shape,) in leaves(geometry):
        if kind != "POLYGON":
            out.append((kind, [shape]))
        elif polygon_is_valid(shape):
            out.append((kind, [shape]))
        elif not skip_invalid:
            out += [("POLYGON", [p]) for p in repaired(shape)]
    return ("GEOMETRYCOLLECTION", out)


def pairs_to_spans(pairs: DataFrame, pixprop: float = 0.5, edge_mode: str = "reference", skip_invalid_polys: bool = False) -> DataFrame:
    """(fid, rid, part, kind, row, col_from, col_to) of ``pairs(fid, rid, wkt, width..py)``: each geometry is read once in one pass, whatever its kind."""
    check_pixprop(pixprop)
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = [x.split()[0] for x in SPANS.split(", ")]

    def put(batch, at, *columns):
        """Rows of ``batch`` at ``at`` with their spans."""
        at = pa.array(at, type=pa.int64())
        own = [batch.column(k).take(at).cast(kind) for k, kind in zip((0, 1), kinds)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, type=k) for c, k in zip(columns, kinds[2:]))], names=names)

    def run(batches):
        grids: dict = {}
        last = geometry = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # results leave in slices
                piece, out, lines = batch.slice(at, 256), [], {}
                for k, (wkt, *grid) in enumerate(zip(*(c.to_pylist() for c in piece.columns[2:]))):
                    if not wkt:
                        continue
                    grid = (*grid,)
                    if grid not in grids:
                        grids[grid] = _spans(Grid(*grid), pixprop, edge_mode, skip_invalid_polys)
                    if wkt != last:  # a feature's pairs follow each other
                        last, geometry = wkt, parse_wkt(wkt)
                        if geometry[0] != "LINESTRING" or list(map(len, geometry[1])) != [2]:
                            geometry = repairable(geometry, skip_invalid_polys)
                    if geometry[0] == "LINESTRING":  # of one segment: all of a slice at once
                        numbers, ends = lines.setdefault(grid, ([], []))
                        numbers.append(k)
                        ends.append((*geometry[1][0][0], *geometry[1][0][1]))
                    else:
                        out += [(k, *x) for x in grids[grid](geometry)]
                if out:
                    yield put(piece, *zip(*out))
                for grid, (numbers, ends) in lines.items():
                    g = Grid(*grid)
                    for i, c, r in segment_cells(np.array(ends), g.envelope(edge_mode), g.x0, g.y0, g.px, g.py):
                        inside = (c >= 0) & (c < g.width) & (r >= 0) & (r < g.height)
                        if inside.any():
                            i, c, r = np.array(numbers)[i[inside]], c[inside].astype(np.int32), r[inside].astype(np.int32)
                            kind = pa.DictionaryArray.from_arrays(np.zeros(len(i), np.int32), ["LINESTRING"]).cast(pa.string())
                            yield put(piece, i, np.zeros(len(i), np.int32), kind, r, c, c)

    return dealt(pairs.select(F.col("fid").cast("long"), "rid", "wkt", *GRID)).mapInArrow(run, SPANS)


#: Lines of a raster that are dealt together, as powers of 2.
BAND = 5


def spread_spans(spans: DataFrame) -> DataFrame:
    """Spans dealt by feature and band of rows (``__band``), so that a polygon over a whole raster is not one task's work."""
    return spans.withColumn("__band", F.shiftright("row", BAND)).repartition("fid", "__band")


def disjoint(spans: DataFrame) -> DataFrame:
    """(fid, rid, row, col_from, col_to): each cell of a feature and raster in one span, whatever parts share it."""
    before = Window.partitionBy("fid", "rid", "__band", "row").orderBy("col_from").rowsBetween(Window.unboundedPreceding, -1)
    s = spread_spans(spans.select("fid", "rid", "row", "col_from", "col_to")).withColumn("__seen", F.max("col_to").over(before))
    s = s.withColumn("col_from", F.greatest("col_from", F.col("__seen") + 1))  # null, of the first span, is passed over
    return s.where("col_from <= col_to").select("fid", "rid", "row", "col_from", "col_to")


def spans_to_cells(spans: DataFrame) -> DataFrame:
    """The columns of ``spans``, with col for col_from and col_to."""
    own = [c for c in spans.columns if c not in ("row", "col_from", "col_to", "__band")]
    return spans.select(*own, F.explode(F.sequence("col_from", "col_to")).alias("col"), "row")


def pairs_to_cells(pairs: DataFrame, pixprop: float = 0.5, edge_mode: str = "reference", skip_invalid_polys: bool = False, spread: bool = True) -> DataFrame:
    """(fid, rid, part, kind, col, row). ``spread``: see :func:`spread_spans`; the exchange carries spans, not cells."""
    spans = pairs_to_spans(pairs, pixprop, edge_mode, skip_invalid_polys)
    return spans_to_cells(spread_spans(spans) if spread else spans)


def on_one(features: DataFrame, g: Grid) -> DataFrame:
    """``features`` paired with one raster."""
    kind = {"width": "int", "height": "int"}
    return features.drop("rid", *GRID).withColumns({"rid": F.lit(g.rid)} | {n: F.lit(getattr(g, n)).cast(kind.get(n, "double")) for n in GRID})


def geometries_to_spans(features: DataFrame, g: Grid, pixprop: float = 0.5, edge_mode: str = "reference", skip_invalid_polys: bool = False) -> DataFrame:
    """(fid, part, kind, row, col_from, col_to) of ``features(fid, wkt)`` of any kind on one raster."""
    return pairs_to_spans(on_one(features, g), pixprop, edge_mode, skip_invalid_polys).drop("rid")


def geometries_to_cells(features: DataFrame, g: Grid, pixprop: float = 0.5, edge_mode: str = "reference", skip_invalid_polys: bool = False, spread: bool = False) -> DataFrame:
    """(fid, part, kind, col, row). Points and lines have each cell once a feature; polygon parts may share cells."""
    return pairs_to_cells(on_one(features, g), pixprop, edge_mode, skip_invalid_polys, spread).drop("rid")


def buffer_wkt(features: DataFrame, amount: float | str, segments: int | str = 1, bounds: bool = True) -> DataFrame:
    """``features`` with the geometry buffered; ``@field`` takes the whole-number distance from a column. ``bounds``: its box follows."""
    field = lambda v, default: F.col(v[1:]).cast("long") if isinstance(v, str) and v.startswith("@") else F.lit(int(float(v if v is not None else default)))
    kept = dealt(features).withColumns({"__d": field(amount, 0), "__s": field(segments, 1)})

    @F.pandas_udf("string")
    def grow(wkt: pd.Series, d: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else to_wkt(buffered(parse_wkt(w), int(a), max(1, int(b)))) for w, a, b in zip(wkt, d, s)], dtype=object)

    out = kept.withColumn("wkt", grow("wkt", "__d", "__s")).drop("__d", "__s")
    return with_bounds(out) if bounds else out


def box_wkt(minx="minx", miny="miny", maxx="maxx", maxy="maxy"):
    """WKT of a bounding box as an expression."""
    at = lambda x, y: F.concat_ws(" ", dbl(x), dbl(y))
    ring = [at(minx, miny), at(maxx, miny), at(maxx, maxy), at(minx, maxy), at(minx, miny)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(",", *ring), F.lit("))"))


def with_bounds(features: DataFrame) -> DataFrame:
    """``features(wkt)`` with minx, miny, maxx, maxy."""

    @F.pandas_udf("minx double, miny double, maxx double, maxy double")
    def bounds(wkt: pd.Series) -> pd.DataFrame:
        rows = [(envelope(parse_wkt(w)) if w else None) or (None,) * 4 for w in wkt]
        return pd.DataFrame(rows, columns=["minx", "miny", "maxx", "maxy"], dtype="float64")

    out = features.withColumn("__b", bounds(F.col("wkt")))
    return out.withColumns({n: F.col(f"__b.{n}") for n in ("minx", "miny", "maxx", "maxy")}).drop("__b")
