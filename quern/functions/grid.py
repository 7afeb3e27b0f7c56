"""Grid mathematics as column expressions. Every coordinate and literal is a double."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The value of pi that angles are computed with.
PI = 3.14159265


def dbl(x) -> Column:
    """A double column from a column, a name or a number."""
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


@dataclass(frozen=True)
class Grid:
    """Size and geotransform of a raster; rows usually run downwards (``py`` below 0)."""

    width: int
    height: int
    x0: float = 0.0
    y0: float = 0.0
    px: float = 1.0
    py: float = -1.0
    rid: str = "raster"
    srs: str = ""
    nodata: float | None = None
    rotation: tuple[float, float] = (0.0, 0.0)

    @property
    def area(self) -> int:
        """How many cells it has."""
        return self.width * self.height

    def envelope(self, edge_mode: str = "reference") -> tuple[float, float, float, float]:
        """(minx, miny, maxx, maxy); in ``reference`` mode the far corner is that of the last pixel."""
        k = {"reference": 1, "full": 0}[edge_mode]
        x1, y1 = self.x0 + self.px * (self.width - k), self.y0 + self.py * (self.height - k)
        return min(self.x0, x1), min(self.y0, y1), max(self.x0, x1), max(self.y0, y1)

    def corner(self, col: float, row: float) -> tuple[float, float]:
        """Geotransform with its rotation terms."""
        a, b = self.rotation
        return self.x0 + self.px * col + a * row, self.y0 + b * col + self.py * row


def col_of(x, g: Grid) -> Column:
    return F.floor((dbl(x) - dbl(g.x0)) / dbl(g.px)).cast("int")


def row_of(y, g: Grid) -> Column:
    return F.floor((dbl(y) - dbl(g.y0)) / dbl(g.py)).cast("int")


def closest_col(x, g: Grid) -> Column:
    """Halves go away from zero."""
    return F.round((dbl(x) - dbl(g.x0)) / dbl(g.px)).cast("int")


def closest_row(y, g: Grid) -> Column:
    return F.round((dbl(y) - dbl(g.y0)) / dbl(g.py)).cast("int")


def grid_x(col, g: Grid) -> Column:
    return dbl(g.x0) + dbl(col) * dbl(g.px)


def grid_y(row, g: Grid) -> Column:
    return dbl(g.y0) + dbl(row) * dbl(g.py)


def in_envelope(x, y, g: Grid, edge_mode: str = "reference") -> Column:
    a, b, c, d = g.envelope(edge_mode)
    return dbl(x).between(a, c) & dbl(y).between(b, d)


def on_grid(col, row, g: Grid) -> Column:
    return F.col(col).between(0, g.width - 1) & F.col(row).between(0, g.height - 1)


def basename(path) -> Column:
    """What follows the last of ``/ : \\``."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"^.*[/:\\]", "")


def rid_of(path, mode: str = "file") -> Column | None:
    """Raster id: ``file`` the base name, ``path`` as given, ``none`` no column."""
    if mode == "none":
        return None
    return {"file": basename(path), "path": F.col(path) if isinstance(path, str) else path}[mode]


def centre(prefix: str = "") -> tuple[Column, Column]:
    """Centre of the bounding box columns."""
    c = lambda n: dbl(prefix + n)
    return (c("minx") + c("maxx")) / F.lit(2.0), (c("miny") + c("maxy")) / F.lit(2.0)


def angle(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx) * F.lit(180.0) / F.lit(PI)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def parse_size(text: str, pixel: float = 1.0) -> float:
    """A length, or a number of pixels if ``px`` follows."""
    m = re.fullmatch(r"\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s*(px)?\s*", str(text))
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return float(m[1]) * (pixel if m[2] else 1.0)


def parity_pad(size: Column, parity) -> Column:
    """1 where ``size`` must grow by one to be even or odd. ``parity``: 'even', 'odd', '@field' or None."""
    if parity is None:
        return F.lit(0)
    if parity.startswith("@"):
        want = F.col(parity[1:])
        return F.when(((want == "even") & (size % 2 != 0)) | ((want == "odd") & (size % 2 == 0)), 1).otherwise(0)
    return F.when(size % 2 != {"even": 0, "odd": 1}[parity], 1).otherwise(0)
