"""From options to plans: the table, statistics, class-count, cut-out, strip and burn outputs of one invocation.

All rasters of an invocation are one relation of pixels and one list of grids, so a plan has one branch
however many rasters there are: features meet rasters by tiles, their geometries are read once in one
Arrow pass, and cells meet pixels by (rid, col, row).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.grid import Grid, parse_size
from quern.operators import cutout, extract, rasterize, select, stats
from quern.session import stored
from quern.sources.tables import raster_list


@dataclass(frozen=True)
class Options:
    """What an invocation asks for; defaults are those of the command line."""

    fields: list[str] | str | None = None
    rid: str = "file"
    col_row: bool = True
    xy: bool = True
    pixprop: float = 0.5
    box: tuple[str, ...] | None = None
    buffer: tuple | None = None
    fid: int | None = None
    where: str | None = None
    skip_invalid_polys: bool = False
    edge_mode: str = "reference"
    nodata: float | None = None
    stats: list[str] = field(default_factory=lambda: ["avg"])
    duplicate: list[tuple] = field(default_factory=list)
    ignore_nodata: str | None = None
    separation: int = 0
    parity: str | None = None
    only_inside: bool = False
    compat: bool = False
    spread: bool = True

    def __post_init__(self):
        if self.box and self.buffer:
            raise ValueError("box and buffer exclude each other")
        rasterize.check_pixprop(self.pixprop)

    @property
    def chooses(self) -> bool:
        return bool(self.duplicate or self.ignore_nodata)


Raster = tuple[Grid, DataFrame]
BOUNDS = ("minx", "miny", "maxx", "maxy")


@dataclass(frozen=True)
class Rasters:
    """``table(idx, rid, width, height, x0, y0, px, py, nodata, ...)`` and ``pixels(rid, col, row, band1...)`` of an invocation."""

    table: DataFrame
    pixels: DataFrame

    @property
    def bands(self) -> list[str]:
        return [c for c in self.pixels.columns if c.startswith("band")]

    @cached_property
    def area(self) -> int | None:
        """How many cells all have, if they are so few that every task may have their pixels."""
        n = self.table.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0
        return n if n <= extract.SMALL else None

    def under(self, cells: DataFrame, *bands: str) -> DataFrame:
        """``cells(rid, col, row)`` with their bands, all or those asked for."""
        px = self.pixels.select("rid", "col", "row", *bands) if bands else self.pixels
        return extract.join_pixels(cells, px, ("rid", "col", "row"), area=self.area)

    def of_bands(self, *bands: str) -> "Rasters":
        return Rasters(self.table, self.pixels.select("rid", "col", "row", *bands))

    @staticmethod
    def of(rasters: "Rasters | list[Raster]") -> "Rasters":
        """Of a list of (grid, pixels); for very many rasters make one of a pixel table written by :func:`quern.sources.sinks.write_pixels`."""
        if isinstance(rasters, Rasters):
            return rasters
        rasters = [rasters] if isinstance(rasters, tuple) else rasters
        if any(g.rotation != (0.0, 0.0) for g, _ in rasters):
            raise ValueError("cells of turned rasters cannot be found from coordinates")
        if len({g.rid for g, _ in rasters}) < len(rasters):
            raise ValueError("a raster is given twice")
        pixels = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [px.drop("rid").withColumn("rid", F.lit(g.rid)) for g, px in rasters])
        n = len([c for c in pixels.columns if c.startswith("band")])
        return Rasters(raster_list(pixels.sparkSession, [g for g, _ in rasters], n), pixels)

    def nodata(self, o: Options) -> float | DataFrame:
        """What fills: the given value (0 too), else each raster's own as (rid, fill)."""
        return o.nodata if o.nodata is not None else self.table.select("rid", F.col("nodata").alias("fill"))


def stacked(rasters: Rasters | list[Raster]) -> Rasters:
    """Several rasters as one with all their bands: cut-outs, strips and burning add the rasters up. Grids must be equal."""
    if isinstance(rasters, (Rasters, tuple)) or len(rasters) < 2:
        return Rasters.of(rasters)
    (g, px), *rest = rasters
    for h, other in rest:
        px = extract.stack(px, other, g, h)
    return Rasters.of([(g, px)])


def chosen_features(features: DataFrame, o: Options) -> DataFrame:
    """One feature by id, which bypasses other filters; or those that meet the condition."""
    if o.fid is not None:
        return extract.by_fid(features, o.fid)
    return features.where(o.where) if o.where else features


def _size(text: str, pixel: str):
    """A size of a box: a number, or of so many pixels."""
    n = parse_size(text)
    return F.lit(float(n)) * F.col(pixel) if str(text).strip().endswith("px") else F.lit(float(n))


def pairs(features: DataFrame, rasters: Rasters, o: Options) -> DataFrame:
    """(fid, rid, wkt, bounds, grid): chosen features with box or buffer applied, with each raster that they may meet.

    The spatial filter is on the bounds that features came with; one feature asked for by id is not filtered by them.
    """
    f = chosen_features(features, o).select("fid", "wkt", *BOUNDS)
    if o.buffer:
        f = rasterize.buffer_wkt(f, *o.buffer, bounds=o.fid is not None) if not str(o.buffer[0]).startswith("@") else _buffered_by_field(features, o)
    grid = rasters.table.select("idx", "rid", *rasterize.GRID)
    if o.box and o.fid is not None:  # the box may reach rasters that its feature does not: the largest one finds them
        w, h = (o.box * 2)[:2]
        px, py = grid.agg(F.max(F.abs("px")), F.max(F.abs("py"))).first()
        own = f.select("fid", *(F.col(n).alias(f"__{n}") for n in BOUNDS))
        wide = rasterize.box_columns(f, parse_size(w, px), parse_size(h, py))
        out = extract.paired(wide, grid, o.edge_mode).drop(*BOUNDS).join(own, "fid").withColumnsRenamed({f"__{n}": n for n in BOUNDS})
    else:
        out = extract.paired(f, grid, o.edge_mode)
    if o.box:
        w, h = (o.box * 2)[:2]
        out = rasterize.box_columns(out, _size(w, "px"), _size(h, "py")).withColumn("wkt", rasterize.box_wkt())
    return out


def _buffered_by_field(features: DataFrame, o: Options) -> DataFrame:
    """As ``pairs`` needs it, with the distances taken from a field."""
    names = {str(x)[1:] for x in o.buffer if str(x).startswith("@")}
    f = chosen_features(features, o).select("fid", "wkt", *BOUNDS, *names)
    return rasterize.buffer_wkt(f, *o.buffer, bounds=o.fid is not None).drop(*names)


def spans_of(features: DataFrame, rasters: Rasters, o: Options, masks: list[Raster] | None = None, keep: bool = False) -> DataFrame:
    """(fid, rid, part, kind, row, col_from, col_to) over all rasters, or over the chosen one of each feature.

    ``keep``: they are stored, for outputs that read them several times.
    """
    spans = rasterize.pairs_to_spans(pairs(features, rasters, o), o.pixprop, o.edge_mode, o.skip_invalid_polys)
    if keep or o.chooses and (o.ignore_nodata or masks):
        spans = stored(spans, "spans")  # read by the screens and the output
    if not o.chooses:
        return spans
    cands = select.candidates(chosen_features(features, o), rasters.table, o.edge_mode)
    if o.ignore_nodata or masks:
        cells = _dealt_cells(spans.select("fid", "rid", "row", "col_from", "col_to"), o)
    if o.ignore_nodata:
        seen = rasters.under(cells)
        nodata = o.nodata if o.nodata is not None else F.col("nodata")
        cands = select.screen_nodata(cands, seen.join(rasters.table.select("rid", "nodata"), "rid"), rasters.bands, nodata, o.ignore_nodata)
    if masks:
        own = masks_of(rasters, masks)
        seen = extract.join_pixels(cells, own, ("rid", "col", "row"), area=rasters.area)
        cands = select.screen_masks(cands, seen, [c for c in own.columns if c.startswith("band")])
    chosen = stored(select.choose(cands, o.duplicate).select("fid", "rid"), "chosen")
    return extract.exchanged(spans).join(chosen, ["fid", "rid"], "left_semi").select(spans.columns)


def _dealt_cells(spans: DataFrame, o: Options) -> DataFrame:
    return rasterize.spans_to_cells(rasterize.spread_spans(spans) if o.spread else spans)


def cells_of(features: DataFrame, rasters: Rasters, o: Options, masks: list[Raster] | None = None, keep: bool = False) -> DataFrame:
    """(fid, rid, part, kind, col, row) of :func:`spans_of`."""
    return _dealt_cells(spans_of(features, rasters, o, masks, keep), o)


def distinct_cells(features: DataFrame, rasters: Rasters, o: Options, masks: list[Raster] | None = None, keep: bool = False) -> DataFrame:
    """(fid, rid, col, row), each once: spans are made disjoint before they become cells. ``keep``: those are stored."""
    spans = rasterize.disjoint(spans_of(features, rasters, o, masks))
    return rasterize.spans_to_cells(stored(spans, "spans") if keep else spans)


def masks_of(rasters: Rasters, masks: list[Raster]) -> DataFrame:
    """Pixels of masks under the ids of the rasters at their place; as many as the shorter list has."""
    own = [m.drop("rid").withColumn("idx", F.lit(k)) for k, (_, m) in enumerate(masks)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own).join(rasters.table.select("idx", "rid"), "idx").drop("idx")


def table(features: DataFrame, rasters: Rasters | list[Raster], o: Options = Options(), masks: list[Raster] | None = None, ordered: bool = False) -> DataFrame:
    """The pixel table; ``ordered``: by raster, feature, column and row."""
    r, attrs = Rasters.of(rasters), extract.select_fields(features, o.fields)
    spans = spans_of(features, r, o, masks)
    if attrs:  # spans are fewer than cells
        spans = extract.exchanged(spans).join(features.select("fid", *attrs), "fid")
    px = r.under(_dealt_cells(spans, o)).join(r.table.select("rid", "idx", "x0", "y0", "px", "py"), "rid")
    if ordered:
        px = px.orderBy("idx", "fid", "col", "row", "part")
    return extract.pixel_table(px, None, attrs, r.bands, o.rid, "rid", o.col_row, o.xy)


def statistics(features: DataFrame, rasters: Rasters | list[Raster], o: Options = Options(), masks: list[Raster] | None = None) -> DataFrame:
    """Zonal statistics a feature and raster: cells are distinct before they meet pixels, attributes join behind the aggregate."""
    r, attrs = Rasters.of(rasters), extract.select_fields(features, o.fields)
    twice = any(s in ("mode", "median") for s in o.stats)  # counts of values are a second pass
    px = r.under(distinct_cells(features, r, o, masks, keep=twice))
    nodata = o.nodata
    if nodata is None:
        px, nodata = px.join(r.table.select("rid", "nodata"), "rid"), F.col("nodata")
    out = stats.two_step_stats(px, r.bands, list(o.stats), ["fid", "rid"], nodata, o.compat)
    out = extract.exchanged(out).join(features.select("fid", *attrs), "fid") if attrs else out
    return out.select("fid", *attrs, *(c for c in out.columns if c not in ("fid", *attrs)))


def classes(features: DataFrame, rasters: Rasters | list[Raster], o: Options = Options(), band: str = "band1", masks: list[Raster] | None = None) -> DataFrame:
    """Class counts a feature and raster. Nodata counts as a class unless a value is given."""
    r = Rasters.of(rasters)
    px = r.under(distinct_cells(features, r, o, masks), band)
    return stats.count_by_class(px, band, ["fid", "rid"], o.nodata)


def _for_images(features: DataFrame, rasters, o: Options, masks) -> tuple[Rasters, DataFrame]:
    """Rasters (all bands of all, or one of them a feature) and cells, whose spans are stored: windows and images read them."""
    r = Rasters.of(rasters) if o.chooses else stacked(rasters)
    return r, cells_of(features, r, o, masks, keep=True).select("fid", "rid", "col", "row")


def mini_rasters(features: DataFrame, rasters: Rasters | list[Raster], o: Options = Options(), prefix: str = "", masks: list[Raster] | None = None, suffix: str = ".img") -> tuple[DataFrame, DataFrame]:
    """(windows, pixels) of the cut-outs."""
    r, cells = _for_images(features, rasters, o, masks)
    keys = ["fid", "rid"]
    windows = cutout.cutout_windows(cells, r.table, prefix, o.parity, keys, suffix)
    return windows, cutout.cutouts(cells, r.pixels, r.table, r.bands, o.only_inside, r.nodata(o), o.parity, keys, r.area)


def strip(features: DataFrame, rasters: Rasters | list[Raster], o: Options = Options(), masks: list[Raster] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layout, strip pixels, moved features). The layout uses sizes without parity; cells that no cut-out covers read the given nodata or 0."""
    r, cells = _for_images(features, rasters, o, masks)
    keys = ["fid", "rid"]
    layout = cutout.strip_layout(cutout.cutout_windows(cells, r.table, keys=keys), o.separation)
    covered = cutout.strip_pixels(layout, r.pixels, r.table, r.bands, r.nodata(o), cells if o.only_inside else None, keys, r.area)
    moved = cutout.strip_features(_shaped(features, r, o), layout, r.table, o.rid)
    return layout, cutout.strip_full(layout, covered, r.bands, o.nodata or 0.0), moved


def _shaped(features: DataFrame, rasters: Rasters, o: Options) -> DataFrame:
    """Chosen features with attributes, and their geometry and bounds as they were rasterized."""
    f = chosen_features(features, o)
    if o.buffer:
        return rasterize.buffer_wkt(f, *o.buffer)
    if not o.box:
        return f
    own = pairs(features, rasters, o).select("fid", "wkt", *BOUNDS).dropDuplicates(["fid"])
    return f.drop("wkt", *BOUNDS).join(own, "fid")


def rasterized(features: DataFrame, rasters: Grid | Rasters | list[Raster], o: Options = Options(), value: int = 1) -> DataFrame:
    """Features burned into an empty raster of the grid (of the first of several, which must be equal)."""
    g = rasters
    if isinstance(rasters, list):
        g = rasters[0][0]
        for h, _ in rasters[1:]:
            extract.check_same_grid(g, h)
    spark = features.sparkSession
    r = rasters if isinstance(rasters, Rasters) else Rasters(raster_list(spark, [g]), features.limit(0))
    if isinstance(rasters, Rasters):
        row = rasters.table.orderBy("idx").first()
        g = Grid(row.width, row.height, row.x0, row.y0, row.px, row.py, row.rid, nodata=row.nodata)
    fill = o.nodata if o.nodata is not None else g.nodata or 0
    return cutout.burn(cells_of(features, r, o), g, value, int(fill))
