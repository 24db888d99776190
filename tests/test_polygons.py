"""Areas of several parts and holes: the shared area against sums over triangles, containment, relations and rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netaudit.functions import geo
from netaudit.functions.relate import related
from netaudit.operators import spatial as G
from netaudit.plans.rules import RULES, Context
from netaudit.sources import readers

FRAME = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"
TWO = "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 7 6, 7 7, 6 7, 6 6)))"


def star(r, centre, n):
    angles = np.sort(r.random(n)) * 2 * np.pi
    return np.asarray(centre) + (0.4 + 0.6 * r.random(n))[:, None] * np.column_stack([np.cos(angles), np.sin(angles)])


def signed(ring):
    x, y = ring.T
    return 0.5 * float(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1)))


def clipped(ring, triangle):
    """What a triangle, turning left, leaves of a convex ring."""
    for a, b in zip(triangle, np.roll(triangle, -1, axis=0), strict=True):
        out = []
        left = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            s, t = left(p), left(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append(p + (q - p) * s / (s - t))
        ring = out
        if not ring:
            break
    return ring


def by_triangles(p, q, cp, cq):
    """Area that two rings share: signed sums over the triangles that their edges form with a centre."""
    total = 0.0
    for a in [np.array([cp, *e]) for e in zip(p, np.roll(p, -1, axis=0), strict=True)]:
        for b in [np.array([cq, *e]) for e in zip(q, np.roll(q, -1, axis=0), strict=True)]:
            sign = np.sign(signed(a)) * np.sign(signed(b))
            a_, b_ = (t if signed(t) >= 0 else t[::-1] for t in (a, b))
            left = clipped(list(a_), b_)
            total += sign * abs(signed(np.array(left))) if len(left) > 2 else 0.0
    return abs(total)


def areas_by_chance(r, n):
    """(rings, centres, signs): a star with a smaller one cut out, and a second part far away."""
    for _ in range(n):
        c = r.random(2)
        outer = star(r, c, 9)
        far = star(r, c + [2.5, 0], 7)
        yield [outer, c + 0.3 * (outer - c), far], [c, c, c + [2.5, 0]], [1, -1, 1]


def test_shared_area_of_parts_and_holes():
    r = np.random.default_rng(3)
    shapes = list(areas_by_chance(r, 24))
    pairs = list(zip(shapes[::2], shapes[1::2], strict=True))
    for (p, cp, sp), (q, cq, sq) in pairs:
        want = sum(s * t * by_triangles(a, b, c, e) for a, c, s in zip(p, cp, sp, strict=True) for b, e, t in zip(q, cq, sq, strict=True))
        assert abs(geo.shared_area(p, q) - want) < 1e-9


def test_blocks_give_the_same_area(monkeypatch):
    shapes = [s[0] for s in areas_by_chance(np.random.default_rng(4), 6)]
    want = [geo.shared_area(p, q) for p in shapes for q in shapes]
    monkeypatch.setattr(geo, "_AT_ONCE", 5)
    assert np.allclose([geo.shared_area(p, q) for p in shapes for q in shapes], want, atol=1e-12)


def test_many_pairs_at_once_and_empty_ones(spark):
    shapes = [s[0] for s in areas_by_chance(np.random.default_rng(5), 20)] + [[]]
    rows = [(i, j, [x.ravel().tolist() for x in shapes[i]], [x.ravel().tolist() for x in shapes[j]]) for i in range(21) for j in range(21)] + [(99, 99, None, [[0.0, 0.0]])]
    df = spark.createDataFrame(rows, "i int, j int, a array<array<double>>, b array<array<double>>")
    for row in df.select("i", "j", geo.overlap_area("a", "b").alias("area")).collect():
        assert abs(row.area - (geo.shared_area(shapes[row.i], shapes[row.j]) if row.i < 21 else 0.0)) < 1e-9


def test_rings_of_text(spark):
    df = spark.createDataFrame([(FRAME,), (TWO,), ("POLYGON EMPTY",), ("LINESTRING (0 0, 1 1)",), (None,)], "w string")
    got = [(r.k, r.n) for r in df.select(geo.wkt_type(F.col("w")).alias("k"), F.transform(geo.parse_rings(F.col("w")), F.size).alias("n")).collect()]
    assert got == [("polygon", [4, 4]), ("polygon", [4, 4, 4]), ("polygon", []), ("linestring", None), (None, None)]


@pytest.mark.parametrize(("wkt", "inside", "beyond"), [(FRAME, [(1, 1), (2.9, 4), (8, 8)], [(4, 4), (3, 4), (0, 5), (6, 6), (10, 1)]), (TWO, [(1, 1), (5.5, 5.5), (8, 6.5)], [(6.5, 6.5), (6, 6.5), (3, 3), (2, 1)])])
def test_points_in_areas(spark, wkt, inside, beyond):
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(inside + beyond)], "id int, x double, y double")
    area = spark.createDataFrame([(wkt,)], "w string").select(geo.parse_rings(F.col("w")).alias("coords"))
    assert sorted(r.id for r in G.outside(points, area, 2.0, [], "id").collect()) == list(range(len(inside), len(inside + beyond)))


BOX = lambda x, y, w: [np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w)], float)]
RINGS = BOX(0, 0, 9) + BOX(3, 3, 3)


@pytest.mark.parametrize(
    ("kind", "a", "want"),
    [
        ("point", [np.array([(4.0, 4.0)])], "0000"), ("point", [np.array([(1.0, 4.0)])], "1010"), ("point", [np.array([(3.0, 4.0)])], "1100"),
        ("line", [np.array([(3.5, 4.0), (5.5, 4.0)])], "0000"), ("line", [np.array([(1.0, 4.0), (2.5, 4.0)])], "1010"), ("line", [np.array([(1.0, 4.0), (8.0, 4.0)])], "1001"),
        ("linestring", [np.array([(3.5, 4.0), (5.5, 4.0)]), np.array([(1.0, 1.0), (2.0, 1.0)])], "1001"),
        ("polygon", BOX(4, 4, 1), "0000"), ("polygon", BOX(3, 3, 3), "1100"), ("polygon", BOX(2, 2, 5), "1000"), ("polygon", BOX(0, 0, 2), "1010"),
        ("polygon", RINGS, "1010"), ("polygon", BOX(3, 3, 3) + BOX(0, 0, 1), "1000"), ("polygon", BOX(0, 0, 1) + BOX(7, 7, 1), "1010"),
    ],
)
def test_relations_to_a_frame(kind, a, want):
    assert "".join(str(int(related(r, kind, a, "polygon", RINGS))) for r in ("intersects", "touches", "within", "crosses")) == want


def test_pairs_of_rings_and_points(spark):
    area = spark.createDataFrame([("frame", FRAME), ("two", TWO)], "id string, w string").select("id", F.lit("polygon").alias("geom_type"), geo.parse_rings(F.col("w")).alias("coords"))
    points = spark.createDataFrame([("p", 4.0, 4.0), ("q", 1.0, 1.0), ("r", 6.5, 6.5)], "id string, x double, y double").select("id", F.lit("point").alias("geom_type"), F.array(geo.xyz(F.col("x"), F.col("y"))).alias("coords"))
    assert sorted(map(tuple, G.spatial_pairs(points, area, "within", 2.0, [], "id").collect())) == [("q", "frame"), ("q", "two"), ("r", "frame")]
    assert [tuple(r) for r in G.overlaps(area, 2.0, [], "id").collect()] == [("frame", "two", 4 + 16 - 1 - 1)]


def test_rules_see_holes_and_parts(spark, tmp_path):
    for layer, rows in {"ZNRO": [("A", FRAME), ("B", "POLYGON ((3.5 3.5, 5 3.5, 5 5, 3.5 5, 3.5 3.5))"), ("C", "MULTIPOLYGON (((20 20, 21 20, 21 21, 20 20)), ((8 8, 12 8, 12 12, 8 12, 8 8)))")], "IMB": [("I1", "POINT (1 1)"), ("I2", "POINT (5.5 5.5)"), ("I3", "POINT (11 11)")]}.items():
        (tmp_path / f"{layer}.csv").write_text("CODE,geometry\n" + "".join(f'{c},"{w}"\n' for c, w in rows))
    x = Context(readers.read_csv_layers(spark, str(tmp_path), wkt="geometry"))
    assert [(r.object_id, r.actual_value) for r in RULES["R-GIS-001"](x).collect()] == [("A", "1.0")]
    assert [r.object_id for r in RULES["R013"](x).collect()] == ["I2"]
