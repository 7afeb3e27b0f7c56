"""Geometry and grids: unit vectors, properties, and the facts of the survey's fixtures."""

import math
import random
import struct

import numpy as np
import pytest

from quern.functions import geom, wkb
from quern.functions.grid import Grid, parse_size
from quern.operators import rasterize


def spans(wkt, g, p=0.5, edge_mode="full", skip=False):
    return rasterize._spans(g, p, edge_mode, skip)(rasterize.repairable(geom.parse_wkt(wkt), skip))


def cells(wkt, g, p=0.5, **k):
    return {(c, row) for _, _, row, a, b in spans(wkt, g, p, **k) for c in range(a, b + 1)}


def test_line_example():
    got = geom.line_cells((10.1, 5.3), (20.6, 10.1), 3, 3, True)
    assert [(c * 3, r * 3) for c, r in got] == [(9, 3), (12, 6), (15, 6), (18, 9)]


def test_line_edges():
    assert geom.line_cells((1.5, 1.5), (1.6, 1.6), 1, 1, True) == [(1, 1)] and geom.line_cells((1.5, 1.5), (1.6, 1.6), 1, 1, False) == []
    assert geom.line_cells((0.5, 0.5), (4.5, 0.5), 1, 1, True) == [(k, 0) for k in range(5)]
    assert geom.line_cells((0.5, 4.5), (0.5, 0.5), 1, 1, False) == [(0, k) for k in (4, 3, 2, 1)]


def test_line_is_incremental():
    """The closed form equals the incremental walk."""
    r = random.Random(1)
    for _ in range(300):
        p, q = ((r.uniform(0, 30), r.uniform(0, 30)) for _ in range(2))
        x1, y1, x2, y2 = (round(256 * v) for v in (*p, *q))
        steep = abs((x2 >> 8) - (x1 >> 8)) < abs((y2 >> 8) - (y1 >> 8))
        a, b, lead, end = (x1, x2, y1 >> 8, y2 >> 8) if steep else (y1, y2, x1 >> 8, x2 >> 8)
        n, want, at, error = abs(end - lead), [], a, 0.0
        if not n:
            continue
        whole, rest = math.floor((b - a) / n), (b - a) % n
        if rest == 0:
            whole, rest = whole - 1, n
        m = rest - n
        for k in range(n + 1):
            lane = lead + (k if (b and (y2 > y1 if steep else x2 > x1)) else -k)
            want.append((at >> 8, lane) if steep else (lane, at >> 8))
            m, at = m + rest, at + whole
            if m > 0:
                m, at = m - n, at + 1
        assert geom.line_cells(p, q, 1, 1, True) == want


@pytest.mark.parametrize("p", [0, 0.1, 0.25, 0.5, 0.75, 1])
def test_rectangles(p):
    r, g = random.Random(2), Grid(20, 20, 0, 20)
    for _ in range(150):
        x, y, w, h = r.uniform(-2, 18), r.uniform(-2, 18), r.uniform(0.1, 6), r.uniform(0.1, 6)
        if r.random() < 0.3:
            x, y, w, h = round(x), round(y), round(w) + 1, round(h) + 1
        wkt = f"POLYGON (({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))"
        want = set()
        for c in range(20):
            for row in range(20):
                lo, hi = 20 - row - 1, 20 - row
                share = max(0, min(x + w, c + 1) - max(x, c)) * max(0, min(y + h, hi) - max(y, lo))
                if share > 1e-9 and share >= p - 1e-9:
                    want.add((c, row))
        assert cells(wkt, g, p) == want


def test_coverage_sums_to_area():
    r = random.Random(3)
    for _ in range(100):
        n = r.randint(3, 9)
        ring = [(10 + r.uniform(2, 9) * math.cos(2 * math.pi * k / n), 10 + r.uniform(2, 9) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        if geom.ring_area(ring) < 0:
            ring.reverse()
        total = 0.0
        for row, by in geom.cell_coverage([ring]).items():
            cover, last = 0.0, None
            for c in sorted(by):
                total += cover * (0 if last is None else c - last - 1)
                total += cover + by[c][0]
                cover, last = cover + by[c][1], c
            assert abs(cover) < 1e-9
        assert abs(total - geom.ring_area(ring)) < 1e-6


def test_hole_bow_tie_and_parts():
    g = Grid(20, 20, 0, 20)
    ring = lambda a, b: f"({a} {a},{b} {a},{b} {b},{a} {b},{a} {a})"
    hole = cells(f"POLYGON ({ring(2, 10)},{ring(4, 8)})", g)
    assert len(hole) == 64 - 16
    assert len(cells("POLYGON ((0 0,10 10,10 0,0 10,0 0))", g, 0.6)) > 20
    assert cells("POLYGON ((0 0,10 10,10 0,0 10,0 0))", g, skip=True) == set()
    assert cells(f"POLYGON ((0 0,10 10,10 0,0 10,0 0),{ring(1, 2)})", g) == set()
    both = f"MULTIPOLYGON (({ring(1, 3)}),({ring(2, 5)}))"
    found = spans(both, g)
    assert {s[0] for s in found} == {0, 1} and sum(s[4] - s[3] + 1 for s in found) == 4 + 9
    twice = spans("MULTIPOINT (0.5 0.5,0.6 0.6,3.5 0.5)", g) + spans("MULTILINESTRING ((0.5 0.5,4.5 0.5),(4.5 0.5,0.5 0.5))", g)
    assert len(twice) == 2 + 5
    mixed = f"GEOMETRYCOLLECTION (POINT (0.5 0.5),LINESTRING (1.5 1.5,3.5 1.5),POLYGON ({ring(6, 8)}))"
    assert len(cells(mixed, g)) == 1 + 3 + 4


def test_edge_modes():
    g = Grid(10, 10, 0, 10)
    assert cells("POINT (9.5 5)", g, edge_mode="full") == {(9, 5)} and cells("POINT (9.5 5)", g, edge_mode="reference") == set()
    assert cells("POINT (9 5)", g, edge_mode="reference") == {(9, 5)}
    assert g.envelope() == (0, 1, 9, 10) and g.envelope("full") == (0, 0, 10, 10)


def test_fixture_windows():
    """Cut-out corners of the survey's headers lie on these columns and rows."""
    for g, x, y, col, row in (
        (Grid(400, 400, 742901.826, 4335165.540), 743009.826, 4334940.54, 108, 225), (Grid(400, 400, 742901.826, 4335165.540), 742901.826, 4335073.54, 0, 92),
        (Grid(400, 400, 742901.826, 4335165.540), 743161.826, 4335091.54, 260, 74), (Grid(400, 400, 742901.826, 4335165.540), 743257.826, 4335031.54, 356, 134),
    ):
        assert all(abs(a - b) < 1e-6 for a, b in zip(g.corner(col, row), (x, y)))


def test_wkt_round_trip_and_clip():
    for w in ("POINT (1 2)", "MULTIPOINT (1 2,3 4)", "LINESTRING (0 0,1 1)", "MULTILINESTRING ((0 0,1 1),(2 2,3 3))", "POLYGON ((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOLYGON (((0 0,4 0,4 4,0 0)))", "GEOMETRYCOLLECTION (POINT (1 2),LINESTRING (0 0,1 1))"):
        assert geom.to_wkt(geom.parse_wkt(w)) == w
    assert geom.parse_wkt("POINT Z (1 2 3)") == ("POINT", [(1.0, 2.0)]) and geom.parse_wkt("POLYGON EMPTY") == ("POLYGON", [])
    with pytest.raises(ValueError):
        geom.parse_wkt("CIRCLE (1 2)")
    assert geom.clip_line([(-5, 5), (5, 5), (5, 20)], (0, 0, 10, 10)) == [[(0, 5), (5, 5), (5, 10)]]
    assert geom.envelope(geom.translated(geom.parse_wkt("POLYGON ((0 0,4 0,4 4,0 0))"), 1, 2)) == (1, 2, 5, 6)


def near(px, py, segments):
    out = np.full(px.shape, np.inf)
    for (x1, y1), (x2, y2) in segments:
        t = np.clip(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / max((x2 - x1) ** 2 + (y2 - y1) ** 2, 1e-18), 0, 1)
        out = np.minimum(out, np.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)))
    return out


SQUARE, HOLED = "POLYGON ((10 10,20 10,20 20,10 20,10 10))", "POLYGON ((5 5,30 5,30 30,5 30,5 5),(12 12,22 12,22 22,12 22,12 12))"
BUFFERS = [
    ("LINESTRING (10 20,30 20)", 3), ("LINESTRING (10 10,20 10,20 25)", 2), (SQUARE, 2), (SQUARE, -2), (SQUARE, -6), (HOLED, 2), (HOLED, -3), ("LINESTRING (5 5,15 5,25 5,25 15,5 15,5 5)", 2),
    ("MULTIPOINT (10 10,12 10,30 30)", 3), ("POLYGON ((5 5,30 5,30 30,20 30,20 12,15 12,15 30,5 30,5 5))", 2), ("POLYGON ((5 5,30 5,30 30,20 30,20 12,15 12,15 30,5 30,5 5))", -2), ("MULTIPOLYGON (((5 5,10 5,10 10,5 10,5 5)),((12 5,17 5,17 10,12 10,12 5)))", 2),
]


@pytest.mark.parametrize(("wkt", "d"), BUFFERS + [("random", k) for k in range(8)])
def test_buffers_are_unions(wkt, d):
    """Cells of a buffer against a fine grid of distances, each once."""
    if wkt == "random":
        r = random.Random(d)
        wkt, d = "LINESTRING (" + ",".join(f"{r.uniform(5, 35):.3f} {r.uniform(5, 35):.3f}" for _ in range(r.randint(2, 7))) + ")", r.randint(1, 4)
    n, sub, g = 40, 12, Grid(40, 40, 0, 40)
    shape = geom.parse_wkt(wkt)
    found = [(c, row) for _, _, row, a, b in spans(geom.to_wkt(geom.buffered(shape, d, 16)), g) for c in range(a, b + 1)]
    gx, gy = np.meshgrid((np.arange(n * sub) + 0.5) / sub, (np.arange(n * sub) + 0.5) / sub)
    polygons, segments = [p for k, (p,) in geom.leaves(shape) if k == "POLYGON"], []
    for kind, (part,) in geom.leaves(shape):
        lines = [[part, part]] if kind == "POINT" else [part] if kind == "LINESTRING" else part
        segments += [s for ln in lines for s in zip(ln, ln[1:])]
    inside = geom.within(np.stack((gx.ravel(), gy.ravel()), 1), polygons).reshape(gx.shape)
    away = near(gx, gy, segments)
    share = ((inside | (away <= d)) if d > 0 else (inside & (away > -d))).reshape(n, sub, n, sub).mean((1, 3))
    want, unsure = ({(x, n - 1 - y) for y in range(n) for x in range(n) if ok(share[y, x])} for ok in (lambda s: s >= 0.5, lambda s: abs(s - 0.5) < 0.06))
    assert len(found) == len(set(found)) and not (set(found) ^ want) - unsure


def test_buffers_of_one_step_and_nothing():
    diamond = geom.buffered(("POINT", [(3.0, 4.0)]), 2)
    assert abs(geom.ring_area(diamond[1][0][0][:-1]) - 8) < 1e-9
    assert geom.buffered(("POINT", [(3.0, 4.0)]), -1) == ("MULTIPOLYGON", []) and geom.buffered(("LINESTRING", []), 2) == ("MULTIPOLYGON", [])


def test_sizes():
    assert parse_size("3") == 3 and parse_size("2.5px", -2) == -5
    with pytest.raises(ValueError):
        parse_size("x")


def test_well_known_binary():
    pack = lambda kind, body, end="<": struct.pack(end + "bI", end == "<", kind) + body
    point, line = struct.pack("<2d", 1, 2), struct.pack("<I4d", 2, 0, 0, 3, 4)
    assert wkb.wkb_to_wkt(pack(1, point)) == "POINT (1 2)" and wkb.wkb_to_wkt(pack(1, struct.pack(">2d", 1, 2), ">")) == "POINT (1 2)"
    assert wkb.wkb_to_wkt(pack(1001, struct.pack("<3d", 1, 2, 9))) == "POINT (1 2)" and wkb.wkb_to_wkt(pack(1 | 0xA0000000, struct.pack("<I3d", 4326, 1, 2, 9))) == "POINT (1 2)"
    assert wkb.wkb_to_wkt(pack(2, line)) == "LINESTRING (0 0,3 4)" and wkb.wkb_to_wkt(None) is None
    ring = struct.pack("<II8d", 1, 4, 0, 0, 4, 0, 4, 4, 0, 0)
    assert wkb.wkb_to_wkt(pack(3, ring)) == "POLYGON ((0 0,4 0,4 4,0 0))"
    assert wkb.wkb_to_wkt(pack(6, struct.pack("<I", 2) + pack(3, ring) * 2)) == "MULTIPOLYGON (((0 0,4 0,4 4,0 0)),((0 0,4 0,4 4,0 0)))"
    assert wkb.wkb_to_wkt(pack(7, struct.pack("<I", 2) + pack(1, point) + pack(2, line))) == "GEOMETRYCOLLECTION (POINT (1 2),LINESTRING (0 0,3 4))"
    assert wkb.wkb_to_wkt(pack(1, struct.pack("<2d", math.nan, math.nan))) == "POINT EMPTY"


@pytest.mark.parametrize(("kind", "wkts"), [(1, ["POINT (1 2)", "POINT (-3.5 4)"]), (3, ["LINESTRING (0 0,1 1,2 0)", "MULTILINESTRING ((0 0,1 1),(5 5,6 6))"]), (5, ["POLYGON ((0 0,9 0,9 9,0 9,0 0),(2 2,2 4,4 4,4 2,2 2))", "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((5 5,7 5,7 8,5 5)))"])])
def test_shapefile_records(kind, wkts):
    shp, shx = wkb.shape_file([(k, geom.parse_wkt(w)) for k, w in enumerate(wkts)], kind)
    back = list(wkb.shape_records(shp))
    assert [k for k, _ in back] == [0, 1] and len(shx) == 100 + 8 * 2 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    area = lambda g: sorted(round(abs(geom.ring_area(geom.open_ring(r))), 9) for p in g[1] for r in p)
    for (_, g), w in zip(back, wkts):
        want = geom.parse_wkt(w)
        assert sorted(geom.leaves(g)) == sorted(geom.leaves(want)) if kind != 5 else (g[0], area(g), sorted(map(len, g[1]))) == (want[0], area(want), sorted(map(len, want[1])))


def test_table_file_round_trip():
    data = wkb.table_file([("n", "bigint"), ("x", "double"), ("s", "string")], [(1, 2.5, "a b"), (None, None, "é")])
    assert wkb.table_records(data) == ([("n", "bigint"), ("x", "double"), ("s", "string")], [(1, 2.5, "a b"), (None, None, "é")])


def test_rectangles_as_polygons():
    rng = random.Random(5)
    for _ in range(3000):
        at = lambda: rng.choice([rng.uniform(-3, 12), rng.randint(-12, 48) / 4])
        (a, c), (b, d) = sorted((at(), at())), sorted((at(), at()))
        if a == c or b == d:
            continue
        ring = [(a, b), (c, b), (c, d), (a, d)]
        assert geom.rectangle([ring + ring[:1]]) == (a, b, c, d)
        for p in (0, 0.25, 0.5, 1.0):
            assert geom.rectangle_spans(a, b, c, d, p, 10, 8) == geom.polygon_spans([ring], p, 10, 8)
    assert geom.rectangle([[(0, 0), (2, 0), (2, 1), (0, 2), (0, 0)]]) is None


def test_segments_at_once():
    rng = random.Random(6)
    box, g = (16.3, 27.5, 113.8, 72.0), (16.3, 72.0, 2.5, -0.5)
    ends = [tuple(rng.choice([rng.uniform(0, 130), float(rng.randint(10, 120))]) for _ in range(4)) for _ in range(2000)]
    ends += [(a, b, a, d) for a, b, _, d in ends[:200]] + [(a, b, c, b) for a, b, c, _ in ends[:200]] + [(a, b, a, b) for a, b, _, _ in ends[:200]]
    got = [[] for _ in ends]
    for numbers, cols, rows in geom.segment_cells(np.array(ends), box, *g, most=500):
        for k, c, r in zip(numbers.tolist(), cols.tolist(), rows.tolist()):
            got[k].append((c, r))
    for (a, b, c, d), cells in zip(ends, got):
        rel = [[(u - g[0], v - g[1]) for u, v in piece] for piece in geom.clip_line([(a, b), (c, d)], box)]
        assert cells == [k for p, q in rel for k in geom.line_cells(p, q, g[2], g[3], True)]
