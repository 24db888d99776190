"""Rules on small hand-built features."""

import pytest

from netaudit.plans.audit import audit, trace_objects
from netaudit.plans.rules import RULES, Context, issues, run_rule
from netaudit.schema import FEATURES


def wkt(text):
    kind = text.split("(")[0].strip().lower().replace("linestring", "line")
    pts = [tuple(map(float, p.split())) for p in text[text.rindex("(") + 1 : text.index(")")].split(",")]
    return kind, [(p[0], p[1], p[2] if len(p) > 2 else None) for p in pts]


def features(spark, rows, project="p"):
    out = []
    for k, (layer, props, geometry) in enumerate(rows):
        kind, coords = wkt(geometry) if geometry else (None, None)
        out.append((project, layer, 0, str(k), k, kind, coords, "EPSG:4326", props, {x: "string" for x in props}, False))
    return spark.createDataFrame(out, FEATURES)


def found(spark, rule, rows, **params):
    return sorted((r.object_id, r.passed) for r in run_rule(Context(features(spark, rows)), rule, **params).collect())


def square(a, b, c, d):
    return f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"


def test_zone_overlap_but_not_touch(spark):
    rows = [("ZNRO", {"CODE": "Z1"}, square(0, 0, 4, 4)), ("ZNRO", {"CODE": "Z2"}, square(2, 0, 6, 4)), ("ZPM", {"CODE": "P1"}, square(0, 0, 2, 2)), ("ZPM", {"CODE": "P2"}, square(2, 0, 4, 2))]
    assert found(spark, "R-GIS-001", rows, size=1.0) == [("Z1", False)]


def test_containment(spark):
    rows = [
        ("ZPM", {"CODE": "PM-1", "REF_PM": "PM-1"}, square(0, 0, 10, 10)), ("SITE", {"CODE": "PM-1", "REF_PM": "PM-1", "TYPE": "PM"}, "POINT (5 5)"), ("SITE", {"CODE": "PM-2", "REF_PM": "PM-1", "TYPE": "PM"}, "POINT (50 50)"),
        ("BOITE", {"CODE": "B-1", "TYPE": "PBO", "REF_PM": "PM-1"}, "POINT (3 3)"), ("BOITE", {"CODE": "B-2", "TYPE": "PBO", "REF_PM": "PM-1"}, "POINT (30 30)"), ("BOITE", {"CODE": "B-3", "TYPE": "PBO", "REF_PM": "PM-1"}, "POINT (10 5)"),
        ("CABLE", {"CODE": "C-1", "TYPE_CABLE": "DISTRIBUTION", "REF_PM": "PM-1"}, "LINESTRING (1 1, 9 9)"), ("CABLE", {"CODE": "C-2", "TYPE_CABLE": "DISTRIBUTION", "REF_PM": "PM-1"}, "LINESTRING (1 1, 20 20)"),
    ]
    assert found(spark, "R-GIS-002", rows) == [("PM-2", False)]
    assert found(spark, "R-GIS-003", rows) == [("B-2", False), ("B-3", False)]
    assert found(spark, "R-GIS-004", rows) == [("C-2", False)]


def test_self_loop_and_end_tolerance(spark):
    rows = [("CABLE", {"CODE": "C-1", "ORIGINE": "B-1", "EXTREMITE": "B-1"}, None), ("CABLE", {"CODE": "C-2", "ORIGINE": "B-1", "EXTREMITE": "B-2"}, None)]
    assert found(spark, "R-GIS-005", rows) == [("B-1", False)]
    rows = [("CABLE", {"CODE": "C-1", "ORIGINE": "B-1", "EXTREMITE": "B-2"}, "LINESTRING (0 0, 0.000005 0.000005)"), ("BOITE", {"CODE": "B-1"}, "POINT (0 0)"), ("BOITE", {"CODE": "B-2"}, "POINT (0.00002 0.00002)")]
    out = run_rule(Context(features(spark, rows)), "R-GIS-006").collect()
    assert [r.field for r in out] == ["end"] and "B-2" in out[0].message


def test_heights_and_clearances(spark):
    rows = [("CABLE", {"CODE": "A"}, "LINESTRING (0 0 3, 1 1 4)"), ("CABLE", {"CODE": "B"}, "LINESTRING (0 0 5, 1 1 6)"), ("CABLE", {"CODE": "C", "MODE_POSE": "AERIEN"}, "LINESTRING (0 0 5, 1 1 8)")]
    assert found(spark, "R-SAFE-001", rows) == [("A", False)] and found(spark, "R-SAFE-002", rows) == [("C", False)]
    rows = [("CABLE", {"CODE": "A"}, "LINESTRING (0 0 10, 2 0 10)")] + [("POWER", {"VOLTAGE": "10KV"}, f"LINESTRING (1 -1 {z}, 1 1 {z})") for z in (6, 5, 7)]
    assert found(spark, "R-SAFE-003", rows, size=1.0) == [("A", False)]
    rows = [("CABLE", {"CODE": "A"}, "LINESTRING (0 0, 0.001 0)"), ("POWER", {}, "LINESTRING (0 0.0000005, 0.001 0.0000005)"), ("POWER", {}, "LINESTRING (0 0.00001, 0.001 0.00001)")]
    assert found(spark, "R-SAFE-004", rows) == [("A", False)]
    rows = [("PTECH", {"CODE": "P"}, "LINESTRING (0 0, 0.01 0)"), ("TREE", {}, "LINESTRING (0.000002 0, 0.000003 0)")]
    assert found(spark, "R-SAFE-011", rows) == [("P", False)]
    rows = [("CABLE", {"CODE": "A", "MODE_POSE": "AERIEN", "LONGUEUR": "1200"}, None), ("CABLE", {"CODE": "B", "MODE_POSE": "AERIEN", "LONGUEUR": "1200", "GROUNDING": "OUI"}, None)]
    assert found(spark, "R-SAFE-012", rows) == [("A", False)]


def test_buried_variants_each_count(spark):
    rows = [("CABLE", {"CODE": "A", "MODE_POSE": "SOUTERRAIN"}, "LINESTRING (0 0, 0.01 0)"), ("WATER", {}, "LINESTRING (0 0.000002, 0.01 0.000002)"), ("WATER", {}, "LINESTRING (0 0.00002, 0.01 0.00002)")]
    assert found(spark, "R-SAFE-010", rows) == [("A", False)] * 3


def test_references(spark):
    rows = [("CABLE", {"CODE": "CDI-001", "ORIGINE": "B-1", "EXTREMITE": "P-1"}, None), ("CABLE", {"CODE": "CDI-002", "ORIGINE": "B-1", "EXTREMITE": "GHOST-9"}, None), ("CABLE", {"CODE": "CDI-003", "ORIGINE": "POP-1", "EXTREMITE": "B-1"}, None), ("BOITE", {"CODE": "B-1", "TYPE": "PBO"}, None), ("BOITE", {"CODE": "B-9", "TYPE": "PBO"}, None), ("PTECH", {"CODE": "P-1"}, None)]
    out = run_rule(Context(features(spark, rows)), "R008").collect()
    assert [(r.object_id, r.actual_value, r.field) for r in out] == [("CDI-002", "GHOST-9", "end")]
    assert found(spark, "R009", rows) == [("B-9", False)]


@pytest.mark.parametrize(("pm", "zone", "n"), [("PM-1", {"CODE": "PM-1"}, 0), ("PM-1", {"CODE": "Z", "REF_PM": "PM-1"}, 0), ("PM-1", {"CODE": "Z", "REF_PM": "X"}, 2)])
def test_pm_and_zone(spark, pm, zone, n):
    assert len(found(spark, "R005_1", [("SITE", {"CODE": pm, "TYPE": "PM"}, None), ("ZPM", zone, None)])) == n


def test_same_route(spark):
    c = lambda code, a, b, n: ("CABLE", {"CODE": code, "ORIGINE": a, "EXTREMITE": b, "NB_FIBRE_U": n}, None)
    assert found(spark, "R-FIBER-002", [c("A", "PM-01", "PBO-01", "6"), c("B", "pm-01", "PBO-01", "2"), c("C", "PM-02", "PBO-01", "2"), c("D", "PM-01", "PBO-01", "0")]) == [("A", False)]
    assert found(spark, "R-FIBER-002", [c("A", "PM-01", "PBO-01", "6"), c("A", "PM-01", "PBO-01", "6")]) == []


def test_capacity_rules(spark):
    rows = [("CABLE", {"CODE": "C", "ORIGINE": "B", "EXTREMITE": "D", "CAPACITE": "144FO"}, None), ("BOITE", {"CODE": "B", "CAPACITE": "12-24FO", "TYPE": "PBO", "NB_FIBRE_UTIL": "13"}, None), ("BOITE", {"CODE": "D", "CAPACITE": "0"}, None)]
    assert found(spark, "R019", rows) == [("C", False)] and found(spark, "R020", rows) == [("B", False)] and found(spark, "R007_1", rows) == [("B", True)]


def test_endpoints_and_breakpoints(spark):
    rows = [("CABLE", {"CODE": "A"}, "LINESTRING (0 0, 0.001 0)"), ("CABLE", {"CODE": "B"}, "LINESTRING (0.001 0, 0.5 0)"), ("BOITE", {"CODE": "X"}, "POINT (0 0)"), ("BOITE", {"CODE": "Y"}, "POINT (0.001 0)")]
    assert found(spark, "R010", rows) == [("B", False)]
    assert found(spark, "R023", rows) == [("A", False), ("B", False)]
    assert found(spark, "R023", rows[:1]) == [("A", False), ("A", False)]


def test_layers_and_registry(spark):
    x = Context(features(spark, [("CABLE", {"CODE": "A"}, "POINT (0 0)"), ("INFRA", {"CODE": "I"}, "LINESTRING (0 0, 1 1)")]))
    assert {r.object_id: r.passed for r in run_rule(x, "R002").collect()}["INFRASTRUCTURE"] is True
    assert {r.object_id: r.passed for r in run_rule(x, "R004").collect()} == {"CABLE": False, "INFRASTRUCTURE": True}
    assert run_rule(x, "R999").first().message == "unknown rule"
    assert len(RULES) == 67


def test_audit_routes_and_traces(spark):
    rows = [("CABLE", {"CODE": "C-1", "ORIGINE": "B-1", "EXTREMITE": "GHOST"}, "LINESTRING (0 0 1, 1 1 1)"), ("BOITE", {"CODE": "B-1"}, "POINT (0 0)")]
    f = features(spark, rows, "full").unionByName(features(spark, rows, "survey"))
    p = spark.createDataFrame([("full", "full_design"), ("survey", "survey_design")], "project_id string, category string")
    got, summary = audit(f, p, rule_ids=["R008", "R-SAFE-001", "R007"])
    rules = {(r.project_id, r.rule_id) for r in got.collect()}
    assert ("full", "R008") in rules and ("survey", "R008") not in rules and ("survey", "R-SAFE-001") in rules
    assert {r.project_id for r in summary.collect()} == {"full", "survey"}
    objects = spark.createDataFrame([("full", "C-1", "cable:C-1"), ("full", "C-1-2", "cable:C-1-2")], "project_id string, code string, ref string")
    one = issues(spark.createDataFrame([("full", "C-1")], "project_id string, code string"), "R008", "CABLE", "see C-1-2")
    assert trace_objects(one, objects).first().object_ref == "cable:C-1-2"
