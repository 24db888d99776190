"""Geometry as arrays of (x, y, z), and areas as arrays of such rings, in Column expressions only, except for polygon overlap and lines that cross."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

COORDS = "array<struct<x:double,y:double,z:double>>"
_A, _E2 = 6378137.0, 0.0066943799901413165  # WGS 84
_GEOGRAPHIC = r"4326|4490|4258|4269|WGS ?84|CGCS|GEOGRAPHIC"


def xyz(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if z is None else z).cast("double").alias("z"))


def wkt_type(wkt: Column) -> Column:
    """point, linestring or polygon, which may have several parts; null for any other."""
    return F.lower(F.nullif(F.regexp_extract(F.upper(wkt), r"^\s*(?:MULTI(?=POLYGON))?(POINT|LINESTRING|POLYGON)", 1), F.lit("")))


def parse_wkt(wkt: Column) -> Column:
    """Vertices of a WKT point, line or polygon (the exterior ring of its first part), 2-D or 3-D. parse_rings has all rings."""
    ring = F.regexp_extract(wkt, r"\(+\s*([^()]*)", 1)
    return F.when(wkt_type(wkt).isNotNull(), F.transform(F.split(ring, ","), lambda p: _vertex(F.split(F.trim(p), r"\s+"))))


def parse_rings(wkt: Column) -> Column:
    """All rings of a WKT polygon of one part or several, exterior rings and holes alike, each without its closing vertex; null for other geometries. A place is
    inside if a ray from it meets the rings an odd number of times, so the rings need no order and no direction."""
    vertices = lambda ring: F.transform(F.split(ring, ","), lambda p: _vertex(F.split(F.trim(p), r"\s+")))
    opened = lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(wkt_type(wkt) == "polygon", F.transform(F.transform(rings, vertices), opened))


def rings_of(rows: DataFrame, coords: str = "coords") -> Column:
    """The geometry of rows as an array of rings or paths, whether the column holds these or the vertices of a single one."""
    kind = rows.schema[coords].dataType
    nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)
    return F.col(coords) if nested else F.array(F.col(coords))


def _vertex(parts: Column) -> Column:
    at = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return xyz(at(0), at(1), at(2))


def to_wkt(kind: str, coords: Column) -> Column:
    text = F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} ("), text, F.lit(")"))


def is_geographic(crs: Column) -> Column:
    return F.coalesce(F.upper(crs).rlike(_GEOGRAPHIC), F.lit(False))


def metres_per_degree(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * 111320.0


def geodesic_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance on the ellipsoid from the radii of curvature at the middle latitude; good to a millionth at 10 km."""
    mid = F.radians((y1 + y2) / 2)
    w = 1 - _E2 * F.pow(F.sin(mid), 2)
    dx = F.pmod(x2 - x1 + 180.0, F.lit(360.0)) - 180.0
    return F.hypot(_A * (1 - _E2) / F.pow(w, 1.5) * F.radians(y2 - y1), _A / F.sqrt(w) * F.cos(mid) * F.radians(dx))


def dist_m(x1: Column, y1: Column, x2: Column, y2: Column, crs: Column) -> Column:
    return F.when(is_geographic(crs), geodesic_m(x1, y1, x2, y2)).otherwise(F.hypot(x2 - x1, y2 - y1))


def first_vertex(coords: Column) -> Column:
    return F.get(coords, F.lit(0))


def last_vertex(coords: Column) -> Column:
    return F.try_element_at(coords, F.lit(-1))


def segments(coords: Column) -> Column:
    """Array of (x1, y1, x2, y2, z1, z2)."""
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), a["z"].alias("z1"), b["z"].alias("z2"))
    n = F.size(coords)
    return F.when(n > 1, F.zip_with(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))), pair)).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,z1:double,z2:double>>"))


def line_length(coords: Column) -> Column:
    return F.aggregate(segments(coords), F.lit(0.0), lambda a, s: a + F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]))


def bbox(coords: Column) -> Column:
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def representative_point(coords: Column, kind: Column) -> Column:
    """A point's own vertex, a line's middle vertex, the mean of a polygon's vertices."""
    n = F.size(coords)
    mean = lambda f: F.aggregate(coords, F.lit(0.0), lambda a, p: a + p[f]) / n
    return F.when(kind == "polygon", xyz(mean("x"), mean("y"))).otherwise(F.get(coords, F.floor(n / 2).cast("int")))


def contains_strict(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring; the border is outside."""
    return rings_contain(F.array(ring), x, y)


def rings_contain(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside an area of any rings, as parse_rings has them; the borders of parts and holes are outside."""
    closed = F.transform(rings, lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(r))
    edges = F.flatten(F.transform(closed, segments))
    cross = lambda s: (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
    on = lambda s: (cross(s) == 0) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
    hits = lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"])
    return (F.size(F.filter(edges, hits)) % 2 == 1) & ~F.exists(edges, on)


def cell_inside(rings: Column, cx: Column, cy: Column, size: float) -> Column:
    """Whether a grid cell lies wholly inside an area of any rings: its middle does, and no edge comes near to it."""
    x, y, half = (cx + 0.5) * size, (cy + 0.5) * size, size / 2 * (1 + 1e-6)
    closed = F.transform(rings, lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(r))
    edges = F.flatten(F.transform(closed, segments))
    apart = lambda s, p, q, m: (F.least(s[p], s[q]) > m + half) | (F.greatest(s[p], s[q]) < m - half)
    off = lambda s: F.abs((s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])) > (F.abs(s["x2"] - s["x1"]) + F.abs(s["y2"] - s["y1"])) * half
    return ~F.exists(edges, lambda s: ~(apart(s, "x1", "x2", x) | apart(s, "y1", "y2", y) | off(s))) & rings_contain(rings, x, y)


def _places(a, b) -> tuple[Column, Column]:
    """Where two segments (x1, y1, x2, y2) meet, as shares of their lengths; null if they are parallel."""
    dx1, dy1, dx2, dy2 = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    d = F.nullif(dx1 * dy2 - dy1 * dx2, F.lit(0.0))
    return ((b["x1"] - a["x1"]) * dy2 - (b["y1"] - a["y1"]) * dx2) / d, ((b["x1"] - a["x1"]) * dy1 - (b["y1"] - a["y1"]) * dx1) / d


def segments_cross(a, b) -> Column:
    """Whether two segments cross inside both. It is cheap, and made for a join's condition."""
    t, u = _places(a, b)
    return (t > 0) & (t < 1) & (u > 0) & (u < 1)


def segment_intersection(a, b) -> Column:
    """The point where two segments cross inside both, as (x, y); null if they don't, or lie along each other."""
    t, _ = _places(a, b)
    return F.when(segments_cross(a, b), F.struct((a["x1"] + t * (a["x2"] - a["x1"])).alias("x"), (a["y1"] + t * (a["y2"] - a["y1"])).alias("y")))


def has_z(coords: Column) -> Column:
    return F.coalesce(first_vertex(coords)["z"].isNotNull(), F.lit(False))


def min_z(coords: Column) -> Column:
    return F.array_min(F.transform(coords, lambda p: p["z"]))


def z_at(coords: Column, x: Column, y: Column) -> Column:
    """Height of the vertex nearest to a point."""
    return F.array_min(F.transform(F.filter(coords, lambda p: p["z"].isNotNull()), lambda p: F.struct((F.pow(p["x"] - x, 2) + F.pow(p["y"] - y, 2)).alias("d"), p["z"].alias("z"))))["z"]


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Grid cells that a box touches, as an array of (cx, cy)."""
    lo = lambda v: F.floor(v / size)
    return F.flatten(F.transform(F.sequence(lo(x0), lo(x1)), lambda cx: F.transform(F.sequence(lo(y0), lo(y1)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


#: Third flattening of WGS 84, and Krüger's series in it to the fourth power: forward, back, and from the conformal latitude.
_N3 = 0.0016792203863836997
_KRUEGER_A = _A / (1 + _N3) * (1 + _N3**2 / 4 + _N3**4 / 64)
_FORWARD = (
    _N3 / 2 - 2 * _N3**2 / 3 + 5 * _N3**3 / 16 + 41 * _N3**4 / 180, 13 * _N3**2 / 48 - 3 * _N3**3 / 5 + 557 * _N3**4 / 1440,
    61 * _N3**3 / 240 - 103 * _N3**4 / 140, 49561 * _N3**4 / 161280,
)
_BACK = (
    _N3 / 2 - 2 * _N3**2 / 3 + 37 * _N3**3 / 96 - _N3**4 / 360, _N3**2 / 48 + _N3**3 / 15 - 437 * _N3**4 / 1440, 17 * _N3**3 / 480 - 37 * _N3**4 / 840, 4397 * _N3**4 / 161280,
)
_LATITUDE = (
    2 * _N3 - 2 * _N3**2 / 3 - 2 * _N3**3 + 116 * _N3**4 / 45, 7 * _N3**2 / 3 - 8 * _N3**3 / 5 - 227 * _N3**4 / 45, 56 * _N3**3 / 15 - 136 * _N3**4 / 35, 4279 * _N3**4 / 630,
)
_UTM = r"^EPSG:32([67])(0[1-9]|[1-5][0-9]|60)$"


def _utm(crs: Column) -> tuple[Column, Column]:
    """Middle meridian in degrees and false northing of a UTM zone; null for another system."""
    zone = F.regexp_extract(F.upper(crs), _UTM, 2).try_cast("int")
    return zone * 6 - 183.0, F.when(F.regexp_extract(F.upper(crs), _UTM, 1) == "7", 1e7).otherwise(0.0)


def _to_utm(coords: Column, middle: Column, north: Column) -> Column:
    """Degrees to metres of a zone by Krüger's series, to well below a millimetre within the zone."""
    e = 2 * math.sqrt(_N3) / (1 + _N3)

    def angles(p: Column) -> Column:
        s, d = F.sin(F.radians(p["y"])), F.radians(F.pmod(p["x"] - middle + 180.0, F.lit(360.0)) - 180.0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        return F.struct(F.atan2(t, F.cos(d)).alias("u"), F.atanh(F.sin(d) / F.sqrt(1 + t * t)).alias("v"), p["z"].alias("z"))

    def metres(q: Column) -> Column:
        u, v = q["u"], q["v"]
        east = sum((a * F.cos(2 * k * u) * F.sinh(2 * k * v) for k, a in enumerate(_FORWARD, 1)), v)
        up = sum((a * F.sin(2 * k * u) * F.cosh(2 * k * v) for k, a in enumerate(_FORWARD, 1)), u)
        return xyz(500000.0 + 0.9996 * _KRUEGER_A * east, north + 0.9996 * _KRUEGER_A * up, q["z"])

    return F.transform(F.transform(coords, angles), metres)


def _from_utm(coords: Column, middle: Column, north: Column) -> Column:
    def angles(p: Column) -> Column:
        return F.struct(((p["y"] - north) / (0.9996 * _KRUEGER_A)).alias("u"), ((p["x"] - 500000.0) / (0.9996 * _KRUEGER_A)).alias("v"), p["z"].alias("z"))

    def plain(q: Column) -> Column:
        u, v = q["u"], q["v"]
        u1 = u - sum((b * F.sin(2 * k * u) * F.cosh(2 * k * v) for k, b in enumerate(_BACK, 1)), F.lit(0.0))
        v1 = v - sum((b * F.cos(2 * k * u) * F.sinh(2 * k * v) for k, b in enumerate(_BACK, 1)), F.lit(0.0))
        return F.struct(F.asin(F.sin(u1) / F.cosh(v1)).alias("c"), F.atan2(F.sinh(v1), F.cos(u1)).alias("d"), q["z"].alias("z"))

    def degrees(q: Column) -> Column:
        latitude = sum((d * F.sin(2 * k * q["c"]) for k, d in enumerate(_LATITUDE, 1)), q["c"])
        return xyz(F.pmod(middle + F.degrees(q["d"]) + 180.0, F.lit(360.0)) - 180.0, F.degrees(latitude), q["z"])

    return F.transform(F.transform(F.transform(coords, angles), plain), degrees)


def is_known_crs(crs: Column) -> Column:
    """Whether reproject() knows the system: a geographic one, Web Mercator or a UTM zone of WGS 84."""
    return is_geographic(crs) | F.coalesce((F.upper(crs) == "EPSG:3857") | F.upper(crs).rlike(_UTM), F.lit(False))


def reproject(coords: Column, src: Column, dst: str) -> Column:
    """Vertices in another reference system, z kept: geographic systems are one, Web Mercator in closed form, UTM zones of WGS 84 by series. Those of the same system, and
    of one that is not known (is_known_crs), stay as they are."""
    to, here = dst.upper(), F.upper(src)
    mercator = lambda p: xyz(F.radians(p["x"]) * _A, F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2)) * _A, p["z"])
    degrees = lambda p: xyz(F.degrees(p["x"] / _A), F.degrees(2 * F.atan(F.exp(p["y"] / _A)) - math.pi / 2), p["z"])
    utm = F.coalesce(here.rlike(_UTM), F.lit(False))
    plain = F.when(is_geographic(src), coords).when(here == "EPSG:3857", F.transform(coords, degrees)).when(utm, _from_utm(coords, *_utm(src)))
    if to == "EPSG:3857":
        there = F.transform(plain, mercator)
    elif re.fullmatch(_UTM, to):
        there = _to_utm(plain, *_utm(F.lit(to)))
    elif to in ("EPSG:4326", "EPSG:4490"):
        there = plain
    else:
        return coords
    return F.when(here == to, coords).otherwise(F.coalesce(there, coords))


def is_box(ring: Column) -> Column:
    """Whether a ring of four vertices is an axis-parallel box: each vertex on a corner of its bounding box, and the ring's area more than half the box's."""
    box, closed = bbox(ring), F.concat(ring, F.slice(ring, 1, 1))
    corner = F.forall(ring, lambda p: ((p["x"] == box["x0"]) | (p["x"] == box["x1"])) & ((p["y"] == box["y0"]) | (p["y"] == box["y1"])))
    twice = F.abs(F.aggregate(segments(closed), F.lit(0.0), lambda acc, s: acc + s["x1"] * s["y2"] - s["x2"] * s["y1"]))
    return F.coalesce((F.size(ring) == 4) & corner & (twice > 1.5 * (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])), F.lit(False))


#: At most so many pairs of edges, or of edges and slabs, are held at once; more are worked off in turns.
_AT_ONCE = 1 << 20


def _edges(areas: np.ndarray, xy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(area, x1, y1, x2, y2), with y1 below y2, of the edges of rings, given by the area that each belongs to, all vertices and the rings' sizes. Level edges bound nothing."""
    after = np.arange(1, len(xy) + 1)
    last = np.cumsum(sizes)[sizes > 0] - 1
    after[last] = last + 1 - sizes[sizes > 0]
    p, q = xy, xy[after]
    up = (p[:, 1] <= q[:, 1])[:, None]
    edges = np.column_stack([np.repeat(areas, sizes), np.where(up, p, q), np.where(up, q, p)])
    return edges[edges[:, 2] < edges[:, 4]]


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items whose counts come to _AT_ONCE at most, or of one item."""
    sums, at = np.cumsum(counts), 0
    while at < len(counts):
        done = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, done + _AT_ONCE, "right")))
        yield at, to
        at = to


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, number) for each number of the ranges that start at `first` and are `counts` long."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def _meeting_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(area, y) where edges of a cross edges of b of the same area; both are sorted by area."""
    first = np.searchsorted(b[:, 0], a[:, 0])
    counts = np.searchsorted(b[:, 0], a[:, 0], "right") - first
    found = [np.zeros((0, 2))]
    for lo, hi in _blocks(counts):
        i, k = _spread(first[lo:hi], counts[lo:hi])
        near = (a[lo + i, 2] <= b[k, 4]) & (b[k, 2] <= a[lo + i, 4])
        p, q = a[lo + i[near]], b[k[near]]
        r, t, gap = p[:, 3:] - p[:, 1:3], q[:, 3:] - q[:, 1:3], q[:, 1:3] - p[:, 1:3]
        d = r[:, 0] * t[:, 1] - r[:, 1] * t[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (gap[:, 0] * t[:, 1] - gap[:, 1] * t[:, 0]) / d, (gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) / d
        met = (d != 0) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
        found.append(np.column_stack([p[met, 0], p[met, 2] + u[met] * r[met, 1]]))
    return np.vstack(found)


def _shared_areas(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The area that each of n pairs of areas shares, for all pairs at once. A sweep over slabs between the heights where an edge of the pair ends or two cross: no edges
    cross within a slab, so from left to right the space between two neighbours is a trapezoid, as wide as in the slab's middle, and shared if an odd number of edges of either
    lies to its left. Every ring has an even number of edges in a slab, so counts over all slabs do as well as counts in each."""
    edges = np.vstack([a, b])
    side = np.repeat([0, 1], [len(a), len(b)])
    marks = np.vstack([edges[:, [0, 2]], edges[:, [0, 4]], _meeting_heights(a, b)])
    order = np.lexsort((marks[:, 1], marks[:, 0]))
    new = np.ones(len(marks), bool)
    new[1:] = (np.diff(marks[order], axis=0) != 0).any(axis=1)
    place = np.empty(len(marks), int)
    place[order] = np.cumsum(new) - 1
    levels = marks[order][new]
    low, high = place[: len(edges)], place[len(edges) : 2 * len(edges)]
    counts = np.cumsum(np.bincount(low, minlength=len(levels)) - np.bincount(high, minlength=len(levels)))
    total = np.zeros(n)
    for lo, hi in _blocks(counts):
        here = np.flatnonzero((low < hi) & (high > lo))
        start = np.maximum(low[here], lo)
        i, slab = _spread(start, np.minimum(high[here], hi) - start)
        e, s = edges[here[i]], side[here[i]]
        top = levels[np.minimum(slab + 1, len(levels) - 1), 1]
        x = e[:, 1] + ((levels[slab, 1] + top) / 2 - e[:, 2]) / (e[:, 4] - e[:, 2]) * (e[:, 3] - e[:, 1])
        by = np.lexsort((x, slab))
        x, s, slab, height = x[by], s[by], slab[by], (top - levels[slab, 1])[by]
        inside = (np.cumsum(s == 0) % 2 == 1) & (np.cumsum(s == 1) % 2 == 1)
        inside[-1:] = False
        at = np.flatnonzero(inside)
        total += np.bincount(levels[slab[at], 0].astype(int), (x[at + 1] - x[at]) * height[at], minlength=n)
    return total


def shared_area(p: list[np.ndarray], q: list[np.ndarray]) -> float:
    """Area that two areas, given as lists of rings, share."""
    rings = lambda area: _edges(np.zeros(len(area)), np.vstack(area), np.array([len(r) for r in area]))
    return float(_shared_areas(rings(p), rings(q), 1)[0]) if p and q else 0.0


def ring_overlap(p: np.ndarray, q: np.ndarray) -> float:
    """Area that two rings share."""
    return shared_area([p], [q])


@F.arrow_udf(DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area that two areas share, given as arrays of rings, each flat as x1, y1, x2, y2, …; the pairs of a batch are swept at once. Null and empty areas share nothing."""

    def edges(areas: pa.Array) -> np.ndarray:
        counts = areas.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rings = areas.flatten()
        sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 2
        return _edges(np.repeat(np.arange(len(areas)), counts), rings.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2), sizes)

    return pa.array(_shared_areas(edges(a), edges(b), len(a)), pa.float64())


@F.pandas_udf(BooleanType())
def lines_cross(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether a segment of one line crosses one of another inside both; lines are flat arrays x1, y1, x2, y2, …"""

    def cross(a: np.ndarray, b: np.ndarray) -> bool:
        p, q = np.asarray(a, float).reshape(-1, 2), np.asarray(b, float).reshape(-1, 2)
        r, t = np.diff(p, axis=0)[:, None], np.diff(q, axis=0)[None]
        gap = q[None, :-1] - p[:-1, None]
        d = r[..., 0] * t[..., 1] - r[..., 1] * t[..., 0]
        d[d == 0] = np.nan
        u, v = (gap[..., 0] * t[..., 1] - gap[..., 1] * t[..., 0]) / d, (gap[..., 0] * r[..., 1] - gap[..., 1] * r[..., 0]) / d
        return bool(((u > 0) & (u < 1) & (v > 0) & (v < 1)).any())

    for a, b in batches:
        yield pd.Series([cross(p, q) for p, q in zip(a, b, strict=True)], dtype=bool)


def flat(coords: Column) -> Column:
    return F.flatten(F.transform(coords, lambda p: F.array(p["x"], p["y"])))


def flat_rings(rings: Column) -> Column:
    return F.transform(rings, flat)
