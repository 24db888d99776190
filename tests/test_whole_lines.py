"""Queries over whole tables and whole lines against brute force on a small fixture."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from netaudit import driver_queries
from netaudit.functions import geo
from netaudit.operators import spatial

ROWS = 12


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """(folder, {vec_id: (label, vertices, heights)}) of lines that wander through the unit square."""
    rng, folder = np.random.default_rng(5), tmp_path_factory.mktemp("lines")
    rows = [(k, rng.uniform(-0.5, 0.5, 64).astype(np.float32).tolist(), k % 3) for k in range(ROWS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), {k: (label, [(e[2 * i], e[2 * i + 1]) for i in range(32)], [e[3 * i % 64] for i in range(32)]) for k, e, label in rows}


def got(spark, name, folder):
    return Counter(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in driver_queries.QUERIES[name](spark, folder).collect())


def crossing_points(p, q):
    for (ax, ay), (bx, by) in zip(p, p[1:]):
        for (cx, cy), (dx, dy) in zip(q, q[1:]):
            d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            t, u = (cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), (cx - ax) * (by - ay) - (cy - ay) * (bx - ax)
            if d and 0 < t / d < 1 and 0 < u / d < 1:
                yield ax + t / d * (bx - ax), ay + t / d * (by - ay)


def test_line_crossing_whole(spark, lines):
    folder, f = lines
    want = Counter((str(f[a][0]), a, b) for a in f for b in f if a < b and f[a][0] == f[b][0] and any(crossing_points(f[a][1], f[b][1])))
    assert got(spark, "line_crossing_whole", folder) == want == got(spark, "line_crossing", folder)


def distance(f, a, b):
    return min(math.dist(p, q) for p in f[a][1] for q in f[b][1])


def test_min_distance_whole(spark, lines):
    folder, f = lines
    want = Counter((a, b, round(round(d, 6), 5)) for a in f for b in f if f[a][0] == 0 and f[b][0] == 1 and (d := distance(f, a, b)) < 0.02)
    assert got(spark, "min_distance_whole", folder) == want == got(spark, "min_distance", folder)


def test_utility_clearance_whole(spark, lines):
    folder, f = lines
    limits = {1: ("water", 0.03), 2: ("gas", 0.02)}
    want = Counter((a, b, limits[f[b][0]][0], round(round(d, 6), 5)) for a in f for b in f if f[a][0] == 0 and f[b][0] and (d := distance(f, a, b)) < limits[f[b][0]][1])
    assert got(spark, "utility_clearance_whole", folder) == want == got(spark, "utility_clearance", folder)


def test_power_gap_whole(spark, lines):
    folder, f = lines
    height = lambda k, at: f[k][2][min(range(32), key=lambda i: math.dist(f[k][1][i], at))]
    gaps = {(a, b): [abs(height(a, p) - height(b, p)) for p in crossing_points(f[a][1], f[b][1])] for a in f for b in f if f[a][0] == 0 and f[b][0] == 1}
    want = Counter((a, b, round(round(min(g), 6), 5)) for (a, b), g in gaps.items() if g)
    assert got(spark, "power_gap_whole", folder) == want == got(spark, "power_gap", folder)


def test_coverage_whole(spark, lines):
    folder, f = lines
    boxes = [(min(x), max(x), min(y), max(y)) for x, y in (zip(*v[1][:4]) for v in f.values())]
    want = Counter((k,) for k, (_, v, _) in f.items() if not any(x0 < v[0][0] < x1 and y0 < v[0][1] < y1 for x0, x1, y0, y1 in boxes))
    assert got(spark, "coverage_whole", folder) == want == got(spark, "coverage", folder)


def test_grounding_whole(spark, lines):
    folder, f = lines
    want = Counter((k,) for k, (_, v, _) in f.items() if sum(map(math.dist, v, v[1:])) > 5.5)
    assert got(spark, "grounding_whole", folder) == want == got(spark, "grounding", folder)


def test_fill_down_whole(spark, tmp_path):
    rows = [(1, 1, "system", "s"), (1, 2, "user", "a question longer than twenty characters"), (1, 3, "assistant", "b"), (1, 4, "user", " " * 25 + "late"), (1, 5, "user", None), (2, 1, "assistant", "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, head = Counter(), {}
    for conv, turn, role, text in rows:
        if role == "user" and (text or "").strip(" "):
            head[conv] = text
        want[(conv, turn, head.get(conv))] += 1
    assert got(spark, "fill_down_whole", str(tmp_path)) == want == got(spark, "fill_down", str(tmp_path))


def test_near_on_earth_at_any_latitude(spark):
    from netaudit.operators import spatial

    rng = np.random.default_rng(2)
    at = [(float(x), float(y)) for y0 in (0.0, 45.0, 80.0, 89.0, -89.9) for x, y in zip(10 + rng.uniform(-0.02, 0.02, 25), y0 + rng.uniform(-0.002, 0.002, 25), strict=True)]
    a, b = (spark.createDataFrame([(k, *p) for k, p in enumerate(at) if k % 2 == m], f"{n} long, x double, y double") for m, n in ((0, "a"), (1, "k")))
    got = {(r.a, r.b_k) for r in spatial.near_on_earth(a, b, 120.0, []).collect()}
    every = a.crossJoin(b.selectExpr("k AS b_k", "x AS b_x", "y AS b_y"))
    from pyspark.sql import functions as F

    from netaudit.functions import geo

    want = {(r.a, r.b_k) for r in every.where(geo.geodesic_m(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y")) <= 120.0).collect()}
    assert got == want and any(a > 75 for a, _ in want)


def test_longest_in_text_finds_short_codes_and_inner_matches(spark):
    from netaudit.operators import joins

    texts = ["the cable AB-12 lies here", "xone two three four fivey", "a b", "two words apart", "", None, "zz"]
    codes = ["AB-12", "AB", "one two three four five", "b", "two words", "two  words", "words apart and more", "", None, "zzz"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    c = spark.createDataFrame([(x,) for x in codes], "code string")
    got = {r.id: r.code for r in joins.longest_in_text(t, "id", "text", c, "code").collect()}
    want = {k: max((x for x in codes if x and x in t), key=lambda x: (len(x), x)) for k, t in enumerate(texts) if t and any(x and x in t for x in codes)}
    assert got == want


def test_sheets_have_no_row_cap(spark):
    from netaudit.operators import lookup

    rows = spark.range(6001).selectExpr("'p' AS project_id", "'BOM' AS sheet", "CAST(id + 1 AS INT) AS row_no", "array(if(id = 0, 'CODE', concat('c', id))) AS cells")
    assert lookup.bom_codes(rows).count() == 6000
    assert lookup.fiber_sheets(rows.withColumn("sheet", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("Fiber"))).count() == 6001


@pytest.mark.parametrize(("piece", "size"), [(2, 0.3), (5, None), (32, None)])
def test_crossing_pairs_of_pieces(spark, piece, size):
    rng, lines = random.Random(piece), []
    for k in range(40):
        x, y, line = rng.random(), rng.random(), []
        for _ in range(rng.choice([1, 2, 7, 40])):
            x, y = x + rng.uniform(-0.2, 0.2), y + rng.uniform(-0.2, 0.2)
            line.append((x, y, None))
        lines.append(("l", k, line))
    rows = spark.createDataFrame([*lines, ("l", 99, []), ("l", 98, None)], f"layer string, id long, coords {geo.COORDS}")
    pairs = lambda f: sorted(tuple(r) for r in f.select("layer", "a_id", "b_id").distinct().collect())
    want = pairs(spatial.crossings(rows, rows, 0.5, ["layer"], ("id", "id"), ordered=True))
    assert len(want) > 10 and pairs(spatial.crossing_pairs(rows, rows, ["layer"], ("id", "id"), size, True, piece)) == want
    assert spatial.crossing_pairs(rows.limit(0), rows.limit(0), ["layer"], ("id", "id"), size, True, piece).count() == 0
