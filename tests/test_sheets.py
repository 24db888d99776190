"""Sheets to features, rules, specifications, parameters and case judgements on small fixtures."""

import datetime

from pyspark.sql import functions as F

from netaudit.operators import sheets as S
from netaudit.plans.audit import audit, case_issues
from netaudit.schema import FEATURES, ISSUES
from netaudit.sources import readers as R

SCHEMA = "project_id string, file string, sheet string, row_no int, cells array<string>"


def book(spark, **sheets):
    return spark.createDataFrame([("p", "f", name, k, cells) for name, rows in sheets.items() for k, cells in enumerate(rows, 1)], SCHEMA)


def test_features_of_sheets(spark):
    s = book(spark, CABLE_1=[["", None], ["编码", "类型", "", "编码"], ["a", "x", "z", "last"], [" ", None], ["b"]], CABLE_2=[["CODE"], ["c"]], L_CABLE=[["CODE"], ["d"]], BOM物料=[["物料编码", "数量"], ["m", " "]])
    got = {(r.layer, r.feature_id, r.feature_seq): r.props for r in S.sheets_to_features(s).collect()}
    assert got[("CABLE", "EXCEL-CABLE-1", 1)] == {"TYPE_CABLE": "x", "CODE": "last"} and got[("CABLE", "EXCEL-CABLE-3", 3)] == {"CODE": "b"}
    assert got[("BOM物料", "EXCEL-BOM物料-1", 1)] == {"CODE": "m", "QTY": ""}
    assert sorted(k for k in got if k[0] == "CABLE")[0][1] == "EXCEL-CABLE-1" and len(got) == 4 and max(k[2] for k in got) == 6


def test_rules_and_specifications(spark):
    s = book(spark, 规则=[["NO.", "", "检测项"], ["1", "1.1", "a\nb", "", "CABLE  BOITE", "x, y,", "r"], ["", "1.2", "c"], ["", "", ""], ["", "", "", "d"], ["2", "", "", "", "L"]])
    got = S.parse_validation_rules(s).orderBy("row_no").collect()
    assert [(r.no, r.sub_no, r.check_item, r.check_content) for r in got] == [("1", "1.1", "a b", ""), ("1", "1.2", "c", ""), ("1", "1.2", "", "d")]
    assert got[0].layers == ["CABLE", "BOITE"] and got[0].fields == ["x", "y"] and got[2].layers == []
    s = book(spark, CABLE=[["title"], ["Nom  champ"], ["NOM CHAMP", "Type de champ", "字段描述", "Longueur"], ["CABLE_AMONT", "text", "d", "max 20"], ["", "text"], ["CODE", "text", "e", "20.0"], ["X"]], 规则=[["nom champ"], ["q"]])
    assert [(r.name, r.type, r.desc_cn, r.desc_fr, r.max_length) for r in S.parse_field_specs(s).orderBy("row_no").collect()] == [("CABLE_AMONT", "text", "d", "", 30), ("CODE", "text", "e", "", 20), ("X", "", "", "", None)]


def test_chosen_sheets(spark):
    s = book(spark, A=[["h"], ["1"], ["2"], ["3"]], B=[["h"], ["1"]])
    assert sorted((r.row_no, r.record["h"], r.total) for r in R.read_sheets_multi(s, ["A"], 2).collect()) == [(2, "1", 3), (3, "2", 3)]


def test_values(spark):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.date(2024, 1, 2), 1.5, [1])], "a timestamp, b date, `c.d` double, e array<int>")
    assert tuple(S.serializable(rows).first()) == ("2024-01-02T03:04:05", "2024-01-02", 1.5, "[1]")
    m = spark.createDataFrame([({"NB_FIBRE_": "1", "CODE_PT": "2", "CODE_PTC": "3"},)], "m map<string,string>")
    assert m.select(S.complete_truncated_fields(F.col("m"))).first()[0] == {"NB_FIBRE_": "1", "CODE_PT": "2", "CODE_PTC": "3", "NB_FIBRE_UTIL": "1"}
    assert [r[0] for r in spark.createDataFrame([("cable_amont_x",), ("CODE",), (None,)], "f string").select(S.max_length_for(F.col("f"), F.lit(9))).collect()] == [30, 9, 9]


def test_files(spark):
    m = spark.createDataFrame([("a", "x.shp", "shp"), ("a", "x.dbf", "dbf"), ("a", "校验规则.xlsx", "xlsx"), ("b", "施工规程.xls", "xls"), ("b", "bom.xlsx", "xlsx"), ("c", "n.txt", "txt"), ("d", "规则.txt", None)], "project_id string, name string, suffix string")
    names = lambda what: [r.name for r in S.files_of(m, what).collect()]
    assert (names("rules"), names("procedures"), names("bom"), names("gpkg")) == (["校验规则.xlsx"], ["施工规程.xls"], ["bom.xlsx"], [])
    assert [(r.base, r.missing) for r in S.missing_sidecars(m, ["project_id"]).collect()] == [("x", ["shx", "prj"])]
    sheets = spark.createDataFrame([("b", "BOM物料"), ("c", "L_CABLE"), ("c", "Sheet1")], "project_id string, sheet string")
    assert dict(S.parseable(m, sheets).collect()) == {"a": True, "b": True, "c": False, "d": False}


def test_layers(spark):
    f = spark.createDataFrame([("p", "INFRA", 2, "1"), ("p", "Infrastructure", 1, "2"), ("q", "INFRA_X", 0, "3")], "project_id string, layer string, layer_order int, feature_id string").withColumn("props", F.create_map(F.lit("Code"), F.lit("N/A"), F.lit("n"), F.lit("1,5")))
    ids = lambda df: sorted(r.feature_id for r in df.collect())
    assert ids(S.match_layer(f, "infra", "exact", first=False)) == ["1", "2"] and ids(S.match_layer(f, "infra", "prefix")) == ["2", "3"] and ids(S.match_layer(f, "STRUCT")) == ["2"]
    got = S.to_entity(f, "INFRASTRUCTURE", {"code": ("CODE", "string"), "n": ("N", "double")}, ("INFRA_X",)).orderBy("feature_id").collect()
    assert [(r.feature_id, r.source_layer, r.code, r.n) for r in got] == [("2", "Infrastructure", None, 1.5), ("3", "INFRA_X", None, 1.5)]


def test_case(spark):
    s = book(
        spark, BOITE=[["CODE"], ["b1"], ["b2"], [" "], ["b1"], ["b1"]], CABLE=[["CODE", "起点", "终点"], ["c1", "b1", "pop9"], ["c2", "b9", None]], BOM物料=[["Material Code"], ["m1"], ["m2"]],
        纤芯连接与分配=[["所属节点", "托盘编号", "光分路器", "IN", "OUT"], ["n", "1", "1:2", "i", "1"], ["n", "1", "1:2", "i", "2"], ["n", "1", "1:2", "i", "3"], ["n", "2", "", "i", "1"], ["n", "2", "无", "i", "2"]],
    )
    known = spark.createDataFrame([("m1",)], "code string")
    got = sorted((r.rule_id, r.object) for r in S.check_case(s, known).collect())
    assert got == sorted(
        [("R-FILE-001", n) for n in ("IMB", "INFRASTRUCTURE", "PTECH", "SITE", "ZNRO", "ZPM")]
        + [("R-FLD-001", "BOITE R3"), ("R-FLD-002", "BOITE CODE=b1"), ("R-FLD-002", "BOITE CODE=b1"), ("R-REL-004", "CABLE c2"), ("R-REL-001", "BOITE b2"), ("R-DAT-001", "n/1/1:2"), ("R-FIBER-001", "纤芯连接与分配 R6"), ("R-BOM-001", "BOM m2")]
    )
    assert not S.check_case(s, known.limit(0)).where("rule_id = 'R-BOM-001'").count() and not S.check_case(s.limit(0)).count()
    assert sorted(r.code for r in S.baseline_codes(s).collect()) == ["m1", "m2"] and S.case_code_empty(s).count() == 1
    assert sorted(r.code for r in S.material_library(s).collect()) == ["m1", "m2"] and S.material_library(s.limit(0)).count() == 29


def test_case_issues(spark):
    s = book(spark, BOITE=[["CODE"], ["b1"], [""]], CABLE=[["CODE", "ORIGINE"], ["c1", "b7"]])
    found = case_issues(s)
    assert found.columns == [x.split(" ")[0] for x in ISSUES.split(", ")]
    got = {(r.rule_id, r.object_id): r.severity for r in found.collect()}
    assert ("R-REL-001", "BOITE b1") in got and ("R-REL-004", "CABLE c1") in got and got[("R-FLD-001", "BOITE R2")] == "warning"


def test_audit_of_sheets(spark):
    s = book(spark, BOITE=[["CODE"], ["b1"], [""]], CABLE=[["CODE", "ORIGINE"], ["c1", "b7"]])
    projects = spark.createDataFrame([("p", "spreadsheet")], "project_id string, category string")
    found, summary = audit(spark.createDataFrame([], FEATURES), projects, rule_ids=["R-REL-001", "R-FLD-001"], sheets=s)
    assert sorted((r.rule_id, r.object_id) for r in found.collect()) == [("R-FLD-001", "BOITE R2"), ("R-REL-001", "BOITE b1")]
    assert [r.project_id for r in summary.collect()] == ["p"]


def test_sheets_of_many_cases_and_of_one_case(spark, monkeypatch):
    """Heads that are broadcast and heads that are hashed give the same, and rows of a sheet that stands for a whole nation stay where they are."""
    import netaudit.operators.joins as J

    rows = [("p", "f", "BOITE", 1, ["CODE"])] + [("p", "f", "BOITE", k, [f"b{k % 90}"]) for k in range(2, 200)] + [("q", "f", "BOITE", 1, ["x", "CODE"]), ("q", "f", "BOITE", 2, ["", "b1"])]
    s = spark.createDataFrame(rows, SCHEMA).repartition(3)
    columns = {"code": ("CODE",)}
    few = S._case_rows(s, F.col("sheet") == "BOITE", columns)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "Window" not in plan
    heads = S._case_heads(s)
    many = J.join_heads(s.where("row_no > 1"), heads.withColumnRenamed("cells", "head"), S.KEYS, 1)
    assert "shuffle_hash" in many._jdf.queryExecution().optimizedPlan().toString()
    assert many.count() == few.count() == 199
    features = sorted((r.project_id, r.feature_seq, r.props["CODE"]) for r in S.sheets_to_features(s).collect())
    assert features[0] == ("p", 1, "b2") and features[-1] == ("q", 1, "b1") and len(features) == 199
    assert S.check_case(s).where("rule_id = 'R-FLD-002'").count() == 198 - 90


def test_equal_headers_and_short_rows(spark):
    """The last of equal headers that a row reaches holds."""
    s = book(spark, BOITE=[["CODE", "编码", "x", "CODE"], ["a"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", None, "beyond"]])
    assert [r.props for r in S.sheets_to_features(s).orderBy("feature_seq").collect()] == [{"CODE": "a"}, {"CODE": "b"}, {"X": "c", "CODE": "d"}, {"X": "c", "CODE": ""}]
