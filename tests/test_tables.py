"""Values, sheets, bill of materials, sources, streams."""

import json

import pytest
from pyspark.sql import functions as F

from netaudit.functions import geo
from netaudit.functions import values as V
from netaudit.operators import aggregates as A
from netaudit.operators import bom as B
from netaudit.operators import fields as C
from netaudit.operators import joins as J
from netaudit.operators import ranks as N
from netaudit.operators import windows as W
from netaudit.sources import readers as R
from netaudit.streaming.submissions import dedupe_submissions


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(("text", "n"), [("1 234,5", 1234.5), ("2_000", 2000.0), ("abc", None), (None, None)])
def test_numbers(spark, text, n):
    assert one(spark, text, V.number) == n


def test_value_functions(spark):
    assert one(spark, "12-24FO", V.first_digits) == 12 and one(spark, "12-24FO", V.all_digits) == 1224
    assert one(spark, " 7.0 ", V.effective_length) == 1 and one(spark, "CDI-UNF-AB-001", lambda c: V.effective_length(c, True, True)) == 2
    assert one(spark, "oui", V.normalize_reuse) == "yes" and one(spark, None, V.normalize_reuse) == "no"
    assert one(spark, "CDI-UNF-PM1-2-3-004", lambda c: V.match_code(c, V.CABLE_CODE, 6)) == ["CDI", "UNF", "PM1", "2", "3", "004"]
    assert one(spark, "X", lambda c: V.match_code(c, V.CABLE_CODE, 6)) is None
    assert one(spark, "35KV", V.voltage_class) == 110 and one(spark, "", V.voltage_class) == 10
    assert one(spark, "CABLE_2", V.sheet_layer) == "CABLE" and one(spark, "L_CABLE", V.sheet_layer) is None
    m = spark.createDataFrame([({"Code": "a"},)], "m map<string,string>").select(V.get_ci(F.col("m"), "CODE"), V.get_ci(F.col("m"), "X")).first()
    assert tuple(m) == ("a", None)


def test_geometry(spark):
    ring = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    inside = lambda x, y: one(spark, ring, lambda c: geo.contains_strict(geo.parse_wkt(c), F.lit(x), F.lit(y)))
    assert inside(1.0, 1.0) and not inside(4.0, 1.0) and not inside(0.0, 0.0) and not inside(5.0, 1.0)
    assert one(spark, "LINESTRING (0 0, 3 4, 3 5)", lambda c: geo.line_length(geo.parse_wkt(c))) == 6.0
    assert abs(one(spark, "x", lambda c: geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) - 111319.49) < 0.1
    assert abs(one(spark, "x", lambda c: geo.geodesic_m(F.lit(179.5), F.lit(0.0), F.lit(-179.5), F.lit(0.0))) - 111319.49) < 0.1
    back = one(spark, "POINT (10 20)", lambda c: geo.reproject(geo.reproject(geo.parse_wkt(c), F.lit("EPSG:4326"), "EPSG:3857"), F.lit("EPSG:3857"), "EPSG:4326"))
    assert abs(back[0].x - 10) < 1e-9 and abs(back[0].y - 20) < 1e-9


def test_ring_overlap_of_concave_rings():
    import numpy as np

    u = np.array([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)], float)
    bar = np.array([(-1, 2), (4, 2), (4, 2.5), (-1, 2.5)], float)
    assert abs(geo.ring_overlap(u, bar) - 1.0) < 1e-12 and geo.ring_overlap(u, bar + 10) == 0


def test_bill(spark):
    q = B.quantities(spark.createDataFrame([("500002050", 5.253, "KM", 1, 4, 1)], "material string, net double, unit string, splice int, pole int, endpoint int")).first()
    assert (q.loss, q.reserve, q.before, q.final) == (0.26265, 0.047, 5.56265, 6.0)
    rows = [("p", "cable", 5.253, "", None, "", None, ""), ("p", "ptech", None, "", "7", "", None, ""), ("p", "ptech", None, "", "7", "", None, "OUI"), ("p", "boite", None, "", None, "", 72, ""), ("p", "boite", None, "", None, "", 16, "")]
    lines = {r.material: r for r in B.build_bom(spark.createDataFrame(rows, "project_id string, obj_type string, length double, extremity string, height string, kind string, capacity int, reuse string")).collect()}
    assert lines["500002050"].final == 6.0 and lines["pole 7 m 4 in"].net == 1.0 and lines["pole 7 m 4 in"].status == "confirm"
    assert lines["500002054"].final == 1.0 and lines["500002142"].final == 1.0 and lines["splicing"].final == 8.0
    cores = B.fiber_cores(spark.createDataFrame([("c", 6, 24, 6), ("d", 0, 24, 6)], "code string, u int, c int, m int"), F.col("u"), F.col("c"), F.col("m"), ["code"]).collect()
    assert len(cores) == 6 and [r.core for r in sorted(cores) if r.tube == 2] == [5, 6]


def sheet(spark, rows, name="s"):
    return spark.createDataFrame([("p", "f", name, k + 1, r) for k, r in enumerate(rows)], "project_id string, file string, sheet string, row_no int, cells array<string>")


def test_fiber_sheets(spark):
    head = ["所属节点", "托盘编号", "光分路器", "IN", "OUT"]
    rows = [head] + [["BPE-01", "01", "无", "Cable-001 Core 5", ""]] * 3 + [["BPE-01", "01", "SP#1 (2:4)", "Cable-001 Core 5", ""]]
    assert W.fiber_core_repeats(sheet(spark, rows)).count() == 2
    port = ["SRO Port", "ODF Code", "ODF Port", "x"]
    rows = [["t"], [""], port, ["1", "ODF01", "1", ""], ["1", "ODF01", "1", ""], ["1", "ODF01", "2", ""]]
    assert [r.core for r in W.fiber_core_repeats(sheet(spark, rows)).collect()] == ["1/ODF01/1"]


def test_headers_pages_and_records(spark):
    rows = [["a", "b"], ["c", "d", "e"], ["h"] * 9, ["1"] * 9, ["2"] * 9]
    assert W.detect_header(sheet(spark, rows), ["sheet"], "row_no", "cells").first().header_row == 3
    s = sheet(spark, [["k", "", "v", "w", "x"], ["1", "2", " 3 ", "4", "5"]])
    assert R.sheet_records(s).first().record == {"k": "1", "Col_2": "2", "v": "3", "w": "4", "x": "5"}
    p = N.page(sheet(spark, [["x"], ["PC 1"], ["y"], ["PC 2"]]), ["sheet"], ["row_no"], 2, 1, F.exists("cells", lambda c: c.contains("PC"))).collect()
    assert [(r.cells, r.total) for r in p] == [(["PC 2"], 2)]


def test_fields_and_summaries(spark):
    d = spark.createDataFrame([("ADSS",), ("adss 12",), ("other",), ("",)], "v string")
    assert [r.value for r in J.in_domain(d, "v", spark.createDataFrame([("ADSS",)], "e string"), "e").collect()] == ["other"]
    known = spark.createDataFrame([("CABLE", "FABRICANT", "FABRICANT")], "layer string, official string, candidate string")
    f = spark.createDataFrame([("CABLE", "FABRIQUANT"), ("CABLE", "FOO")], "layer string, field string")
    assert [(r.field, r.suggestion) for r in J.suggest(f, known).collect()] == [("FABRIQUANT", "FABRICANT")]
    i = spark.createDataFrame([("p", True, "error"), ("p", False, "warning"), ("p", False, "fatal"), ("p", False, "error")], "project_id string, passed boolean, severity string")
    assert tuple(A.severity_counts(i, ["project_id"]).first()) == ("p", 4, 1, 2, 1)
    a = A.accuracy(spark.createDataFrame([(1,), (2,)], "c int"), spark.createDataFrame([(2,), (3,)], "c int"), ["c"]).first()
    assert (a.tp, a.fp, a.fn, a.f1) == (1, 1, 1, 0.5)
    m = C.missing_fields(spark.createDataFrame([("B", "CAPACITE_M")], "layer string, field string"), spark.createDataFrame([("B", "CAPACITE_MAX"), ("B", "NOM")], "layer string, field string"))
    assert [r.field for r in m.collect()] == ["NOM"]


def test_sources(spark, tmp_path):
    (tmp_path / "BOITE.csv").write_text('CODE,geom\nB,"POINT (1 2)"\nC,\n')
    f = R.read_csv_layers(spark, str(tmp_path / "BOITE.csv"), wkt="geom", crs="EPSG:4326").collect()
    assert [(r.layer, r.props, r.geom_type) for r in sorted(f, key=lambda r: r.feature_seq)] == [("BOITE", {"CODE": "B"}, "point"), ("BOITE", {"CODE": "C"}, None)]
    (tmp_path / "SITE.json").write_text(json.dumps([{"CODE": "S", "N": 1}, {"CODE": "T"}]))
    assert R.read_json_layers(spark, str(tmp_path / "SITE.json")).count() == 2
    assert {r.suffix for r in R.file_manifest(spark, str(tmp_path)).collect()} == {"csv", "json"}
    (tmp_path / "l.txt").write_text("head;x\nADSS;1\nADSS;2\nG652,3\n")
    assert sorted(r.entry for r in R.read_domain_list(spark, str(tmp_path / "l.txt")).collect()) == ["ADSS", "G652"]


def test_stream_dedupe(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("2024-01-01T00:00:00", "a"), ("2024-01-01T00:10:00", "a"), ("2024-01-01T00:20:00", "b")]
    (src / "0.json").write_text("\n".join(json.dumps({"ts": t, "c": c}) for t, c in rows))
    s = spark.readStream.schema("ts timestamp, c string").json(str(src))
    q = dedupe_submissions(s, "ts", ["c"]).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.c for r in spark.table("deduped").collect()) == ["a", "b"]
