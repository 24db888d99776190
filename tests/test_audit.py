"""The whole audit: one pass for rules on single features, faults kept apart, tracing, reference lists, nearest ends."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netaudit.operators import joins as J
from netaudit.operators import spatial as G
from netaudit.plans import rules as R
from netaudit.plans.audit import audit, objects_of, skipped, trace_objects
from netaudit.plans.row_rules import ROW_RULES, row_issues
from netaudit.schema import FEATURES, SHEETS
from tests.test_rules import features, square

ROWS = [
    ("CABLE", {"CODE": "C-1", "ORIGINE": "B-1", "EXTREMITE": "B-1", "NB_FIBRE_U": "12", "CAPACITE": "6"}, "LINESTRING (0 0 3, 1 1 4)"),
    ("CABLE", {"CODE": "C-2", "MODE_POSE": "AERIEN", "LONGUEUR": "900"}, "LINESTRING (0 0 5, 1 1 8)"),
    ("BOITE", {"CODE": "B-1", "TYPE": "PBO", "NB_FIBRE_UTIL": "13", "CAPACITE": "12FO"}, "POINT (0 0)"),
    ("BOITE", {"CODE": "B-2", "TYPE": "PBO", "NB_FIBRE_UTIL": "3", "CAPACITE": "99999999999999999999"}, "POINT (0 0)"),
    ("BOITE", {"CODE": " ", "TYPE": "PBO"}, "POINT (0 0)"), ("SITE", {"CODE": "S" * 40}, None), ("L_TYPE", {"CODE": " "}, None),
]


def test_rules_on_single_features_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "f")
    features(spark, ROWS).write.parquet(path)
    x = R.Context(spark.read.parquet(path))
    plan = R.run_all(x, list(ROW_RULES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    together = sorted(tuple(r) for r in R.run_all(x, list(ROW_RULES)).collect())
    apart = sorted(tuple(r) for i in ROW_RULES for r in R.run_rule(x, i).collect())
    assert together == apart
    assert sorted((r[1], r[3]) for r in together) == sorted([
        ("R-GIS-005", "B-1"), ("R012", "C-1"), ("R020", "B-1"), ("R020", "B-2"), ("R007_1", "B-1"), ("R007_1", "B-2"), ("R-SAFE-001", "C-1"), ("R-SAFE-002", "C-2"), ("R-SAFE-012", "C-2"),
        ("R005", "4"), ("R032", "S" * 40),
    ])


def test_a_poisoned_value_is_one_failure_row(spark):
    got = [r for r in R.run_all(R.Context(features(spark, ROWS)), ["R020", "R012"]).collect() if r.object_id == "B-2"]
    assert [(r.rule_id, r.passed, r.message, r.actual_value) for r in got] == [("R020", False, "the value can't be read", "99999999999999999999")]
    lost = features(spark, [("CABLE", {"CODE": "C", "MODE_POSE": "AERIEN"}, "LINESTRING (0 0, nan 1)")])
    assert [r.message for r in R.run_all(R.Context(lost), ["R-SAFE-012"]).collect()] == ["the value can't be read"]


def test_a_rule_that_cannot_be_planned_leaves_the_others(spark, monkeypatch):
    monkeypatch.setitem(ROW_RULES, "R012", lambda **k: F.col("no_such_column"))
    got = {(r.rule_id, r.message) for r in R.run_all(R.Context(features(spark, ROWS)), ["R012", "R-GIS-005", "R999"]).collect()}
    assert ("R012", "rule failed: AnalysisException") in got and ("R999", "unknown rule") in got and any(r == "R-GIS-005" for r, _ in got)


def test_a_rule_that_fails_at_run_time_is_a_row(spark, tmp_path, monkeypatch):
    def bad(x, **k):
        return R.issues(x.cables.where(F.raise_error(F.lit("boom")).isNull()), "R008", "CABLE", "never")

    monkeypatch.setitem(R.RULES, "R008", bad)
    x = R.Context(features(spark, ROWS))
    for _ in range(2):  # again over the same folder: the same table
        got = R.run_each(x, str(tmp_path / "audit"), ["R008", "R012", "R010"])
        assert {r.rule_id for r in got.collect()} == {"R008", "R012", "R010"}
        assert [(r.project_id, r.message.split(":")[0]) for r in got.where("rule_id = 'R008'").collect()] == [("p", "rule failed")]


def test_lengths_and_their_overrides(spark):
    f = R.Context(features(spark, [("CABLE", {"CABLE_AMON": "x" * 25, "REF": "y" * 25}, None)]))
    specs = [("CABLE", "CABLE_AMON", "Texte", 20), ("CABLE", "REF", "Texte", 20), ("CABLE", "REF", "Texte", 10)]
    assert [r.field for r in R.run_all(f, ["R032"], {"R032": {"specs": specs}}).collect()] == ["REF"]
    assert sorted(r.field for r in R.run_all(f, ["R032"], {"R032": {"specs": specs, "overrides": {}}}).collect()) == ["CABLE_AMON", "REF"]
    assert R.run_all(f, ["R032"], {"R032": {"specs": specs[:1], "overrides": {"CABLE_AMONT": 25}}}).count() == 0


def test_layers_that_are_missing_fail(spark):
    x = R.Context(features(spark, ROWS[:1]))
    assert {r.object_id for r in R.run_rule(x, "R003").collect() if r.passed} == {"CABLE"} and R.run_rule(x, "R003").count() == 8


def test_files_of_layers(spark):
    manifest = spark.createDataFrame([("p", "a/Cable.SHP".split("/")[1]), ("p", "infra.shp"), ("q", "other.txt")], "project_id string, name string")
    rows = R.run_rule(R.Context(features(spark, [])), "R001", manifest=manifest).collect()
    assert len(rows) == 64 and {(r.project_id, r.object_id) for r in rows if r.passed} == {("p", "CABLE.shp"), ("p", "INFRASTRUCTURE.shp")}
    assert R.run_rule(R.Context(features(spark, ROWS)), "R001").count() == 0


# reference lists


def _known(value, entries):
    v, entries = value.strip().upper(), [e.strip().upper() for e in entries if e.strip()]
    first = lambda t: t.split()[0].split(";")[0].split(",")[0] if t.split() else ""
    return any(v == e or v in e or e in v or first(v) == first(e) for e in entries)


def test_in_domain_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6)))
    values = list({rnd.choice((word(), word() + " " + word(), word() + ";" + word(), "")) for _ in range(400)})
    lists = {"one": [word() for _ in range(3)] + ["", "long enough entry"], "two": ["abc def", "é,b"], "none": []}
    v = spark.createDataFrame([(k, x) for k in lists for x in values], "k string, v string")
    d = spark.createDataFrame([(k, e) for k, es in lists.items() for e in es], "k string, e string")
    got = {(r.k, r.value) for r in J.in_domain(v, "v", d, "e", ("k",)).collect()}
    assert got == {(k, x) for k, es in lists.items() if any(e.strip() for e in es) for x in values if not _known(x, es)}
    plan = J.in_domain(v, "v", d, "e", ("k",))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_domain_rule(spark):
    x = R.Context(features(spark, [("CABLE", {"CODE": "A", "M": "Acome"}, None), ("CABLE", {"CODE": "B", "M": "nobody"}, None), ("SITE", {"CODE": "C", "M": "nobody", "N": "z"}, None)]))
    d = spark.createDataFrame([("cab", "M", "ACOME SA"), ("*", "N", "w"), ("SITE", "X", "q")], "layer string, field string, entry string")
    assert sorted((r.object_id, r.field) for r in R.run_rule(x, "R031", domains=d).collect()) == [("B", "M"), ("C", "N")]
    assert R.run_rule(x, "R031").count() == 0


# tracing


def test_texts_meet_only_codes_that_they_contain(spark):
    codes = spark.range(3000).selectExpr("concat('C-', id + 100000) AS c")
    texts = spark.range(300).selectExpr("concat('needs c-', id + 100000, ' and 1000') AS t")
    met = J._met_codes(texts.selectExpr("upper(t) AS t"), "t", codes, "c", [])
    assert met.count() == 300
    join = met._jdf.queryExecution().analyzed()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, join.child())
    assert rows.count() <= 600  # before the test of containment


def test_contained_codes_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab. é-") for _ in range(rnd.randint(1, n)))
    codes = [(p, word(7)) for p in "pq" for _ in range(60)] + [("p", "COMMON-" + word(3)) for _ in range(40)] + [("p", ""), ("p", " "), ("p", None)]
    texts = [(p, word(60)) for p in "pqr" for _ in range(120)] + [("p", "see COMMON-ab"), ("p", ""), ("p", None)]
    got = {(r.k, r.text): r.code for r in J.contained_codes(spark.createDataFrame(texts, "k string, t string"), "t", spark.createDataFrame(codes, "k string, c string"), "c", ["k"]).collect()}
    want = {}
    for p, t in texts:
        held = [c for q, c in codes if q == p and c and c.strip() and t and c in t]
        if held:
            want[p, t] = min(held, key=lambda c: (-len(c), c))
    assert got == want


def test_trace(spark):
    f = features(spark, [("CABLE", {"CODE": "Pbo.é-1"}, None), ("BOITE", {"CODE": "Pbo.é-12"}, None), ("BOITE", {"CODE": "pbo.É-12"}, None)])
    assert {(r.code, r.ref) for r in objects_of(f).collect()} == {("PBO.É-1", "CABLE:0"), ("PBO.É-12", "BOITE:2")}
    rows = spark.createDataFrame([("p", "x", "near to pBo.é-12!"), ("p", "PBO.é-1x", "m"), ("q", "x", "pbo.é-12"), ("p", "x", "nothing")], "project_id string, code string, m string")
    issues = R.issues(rows, "R008", "CABLE", F.col("m")).unionByName(R.issues(rows.limit(1), "R009", "CABLE", F.col("m"), passed=F.lit(True)))
    got = sorted((r.project_id, r.message, r.passed, r.object_ref or "") for r in trace_objects(issues, objects_of(f)).collect())
    assert got == sorted([("p", "near to pBo.é-12!", False, "BOITE:2"), ("p", "m", False, "CABLE:0"), ("q", "pbo.é-12", False, ""), ("p", "nothing", False, ""), ("p", "near to pBo.é-12!", True, "")])


def test_audit_from_sheets_to_a_traced_summary(spark, tmp_path):
    sheet = lambda p, name, *rows: [(p, "f.xlsx", name, k, list(r)) for k, r in enumerate(rows, 1)]
    cells = sheet("p", "CABLE", ("CODE", "ORIGINE", "EXTREMITE", "NB_FIBRE_U", "CAPACITE"), ("C-1", "B-1", "GHOST-9", "12", "6"), ("", "B-1", "B-1", "", "")) + sheet("p", "BOITE", ("CODE", "TYPE"), ("B-1", "PBO"), ("B-1", "PBO"))
    sheets = spark.createDataFrame(cells, SHEETS)
    projects = spark.createDataFrame([("p", "full_design"), ("empty", "full_design")], "project_id string, category string")
    none = spark.createDataFrame([], FEATURES)
    for path in (None, str(tmp_path / "audit")):
        found, summary = audit(none, projects, sheets=sheets, path=path, rule_ids=["R008", "R-GIS-005", "R007", "R-FLD-001", "R-FILE-001", "R-REL-004"])
        rows = found.collect()
        by = {(r.project_id, r.rule_id, r.object_id): r for r in rows}
        assert by["p", "R008", "C-1"].object_ref == "CABLE:EXCEL-CABLE-1" and by["p", "R-GIS-005", "B-1"].fix_suggestion
        assert ("p", "R-FLD-001", "CABLE R2") in by and ("p", "R007", "B-1") in by
        assert len([r for r in rows if r.project_id == "empty" and r.rule_id == "R-FILE-001"]) == 10
        assert {r.project_id: r.total for r in summary.collect()} == {p: len([r for r in rows if r.project_id == p]) for p in ("p", "empty")}
    assert audit(none, projects, rule_ids=[])[0].count() == 0 and audit(none, projects, sheets=sheets, rule_ids=[])[0].count() == 0


def test_skipped(spark):
    projects = spark.createDataFrame([("a", "spreadsheet"), ("b", "survey_design"), ("c", "full_design")], "project_id string, category string")
    got = {(r.project_id, r.rule_id) for r in skipped(projects, ["R001", "R008", "R-GIS-001"]).collect()}
    assert got == {("a", "R001"), ("a", "R-GIS-001"), ("b", "R008")}


def test_repeated_codes_take_the_last_device(spark):
    box = lambda at, cap: ("BOITE", {"CODE": "B", "CAPACITE": cap}, f"POINT ({at} 0)")
    rows = [box(0, "24"), box(0.001, "6"), ("BOITE", {"CODE": "D"}, "POINT (0.002 0)"), ("CABLE", {"CODE": "C", "ORIGINE": "B", "EXTREMITE": "D", "CAPACITE": "12"}, "LINESTRING (0.001 0, 0.002 0)")]
    for n in (1, 5):
        x = R.Context(features(spark, rows).repartition(n))
        assert R.run_rule(x, "R024").count() == 0
        assert [(r.actual_value, r.expected_value) for r in R.run_rule(x, "R019").collect()] == [("12", "6")]


# nearest ends


def _metres(a, b):
    mid = math.radians((a[1] + b[1]) / 2)
    w = 1 - 0.0066943799901413165 * math.sin(mid) ** 2
    dx = (b[0] - a[0] + 180) % 360 - 180
    return math.hypot(6378137.0 * (1 - 0.0066943799901413165) / w**1.5 * math.radians(b[1] - a[1]), 6378137.0 / math.sqrt(w) * math.cos(mid) * math.radians(dx))


@pytest.mark.parametrize(("x0", "y0"), [(0, 0), (10, 60), (-30, 85), (180, 10), (180, -60)])
def test_nearest_in_metres_brute_force(spark, x0, y0):
    rnd = random.Random(y0)
    rows = []
    for k in range(60):
        spread = rnd.choice((0.001, 0.02, 3.0))
        x = (x0 + rnd.uniform(-spread, spread) / max(0.1, math.cos(math.radians(y0))) + 180) % 360 - 180
        rows.append(("p", k, f"c{k % 7}", x, y0 + rnd.uniform(-spread, spread)))
    rows += [("lone", 1, "c", float(x0) % 180, float(y0)), ("lone", 2, "c", float(x0) % 180, float(y0))]
    got = {(r.project_id, r.id): (r.d, r.nearest) for r in G.nearest_on_earth(spark.createDataFrame(rows, "project_id string, id int, code string, x double, y double"), ["project_id"], ["id"], "code", 100.0).collect()}
    assert len(got) == len(rows)
    for p, k, c, x, y in rows:
        others = [(_metres((x, y), (r[3], r[4])), r[2]) for r in rows if r[0] == p and r[2] != c]
        if not others:
            assert got[p, k] == (None, None)
        else:
            assert got[p, k][0] == pytest.approx(min(others)[0], rel=1e-9)


def test_a_nearer_end_in_metres_closes_the_gap(spark):
    line = lambda code, a, b: ("CABLE", {"CODE": code}, f"LINESTRING ({a}, {b})")
    rows = [line("A", "0 60", "0 50"), line("N", "0 60.00095", "0 70"), line("E", "0.0015 60", "20 50")]
    got = {(r.object_id, r.field) for r in R.run_rule(R.Context(features(spark, rows)), "R023").collect()}
    assert ("A", "start") not in got and ("E", "start") not in got and ("N", "start") in got
    assert square(0, 0, 1, 1).startswith("POLYGON") and row_issues(R.Context(features(spark, rows)).features, {})[0].count() == 0


def test_places_meet_once_however_many_ends_they_hold(spark):
    """Many ends at a place, of one code and of several: brute force, and pairs that grow with the places."""
    rnd = random.Random(20)
    spots = [(rnd.uniform(0, 1), rnd.uniform(0, 1)) for _ in range(40)]
    rows = [(k, rnd.choice("abc") if p % 4 else "a", *spots[p]) for k, p in enumerate(rnd.choice(range(40)) for _ in range(2000))] + [(5000, None, 0.5, 0.5), (5001, "b", None, 0.1)]
    df = spark.createDataFrame(rows, "id int, code string, x double, y double")
    got = {r.id: (r.d, r.nearest) for r in G.nearest_other(df, [], ["id"], "code", 0.3).collect()}
    assert len(got) == 2002 and got[5000] == got[5001] == (None, None)
    places = {(c, x, y) for _, c, x, y in rows if c and x is not None}
    for k, c, x, y in rows[:2000]:
        d, n = min((math.hypot(x - a, y - b), o) for o, a, b in places if o != c)
        assert got[k][0] == pytest.approx(d, abs=1e-12) and got[k][1] == n
    lone = G.nearest_other(df.where("code = 'a'"), [], ["id"], "code", 0.3).collect()
    assert lone and all(r.d is None and r.nearest is None for r in lone)
    before, pairs, near = G.near_points, [], G.near_points
    try:
        G.near_points = lambda *a: pairs.append(a[1].count()) or near(*a)
        G.nearest_other(df, [], ["id"], "code", 0.3).count()
    finally:
        G.near_points = before
    assert max(pairs) <= 80  # two codes a place, not 2000 ends
