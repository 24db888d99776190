"""Queries that bind the operators on sheets, objects and pairs to the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netaudit.driver_queries import _E, _RECT, _features, _rectangles, _t, query
from netaudit.functions import geo
from netaudit.functions import values as V
from netaudit.operators import ranks as N
from netaudit.operators import sheets as S
from netaudit.operators import spatial as G
from netaudit.operators.cut import cut

#: Line items as rows of sheets: a project a supplier, three sheets each, of which one is an official layer, one an official layer by its name's end and one a lookup table.
_ITEMS = """(SELECT l_suppkey::VARCHAR AS project_id, ['BOITE', 'PLAN_CABLE', 'L_TYPE'][l_linenumber % 3 + 1] AS sheet, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) + 2 AS row_no,
l_partkey::VARCHAR AS code, l_linestatus AS kind, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS flag FROM lineitem)"""


def _item_sheets(spark, d):
    from pyspark.sql.window import Window

    third = F.col("l_linenumber") % 3
    w = Window.partitionBy("l_suppkey", "sheet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    base = _t(spark, d, "lineitem").withColumn("sheet", F.when(third == 0, "BOITE").when(third == 1, "PLAN_CABLE").otherwise("L_TYPE")).select(
        F.col("l_suppkey").cast("string").alias("project_id"), F.lit("f").alias("file"), "sheet", (F.row_number().over(w) + 2).alias("row_no"),
        F.array(F.col("l_partkey").cast("string"), "l_linestatus", F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")), F.lit("last")).alias("cells"),
    )
    heads = base.select("project_id", "file", "sheet").distinct().select("*", F.explode(F.array(F.struct(F.lit(1).alias("row_no"), F.array(F.lit(" ")).alias("cells")), F.struct(F.lit(2).alias("row_no"), F.array(*map(F.lit, ("编码", "类型", "状态", ""))).alias("cells")))).alias("h"))
    return base.unionByName(heads.select("project_id", "file", "sheet", "h.*"))


@query(f"""SELECT project_id, replace(sheet, 'PLAN_', '') AS layer, sheet AS source_layer, 'EXCEL-' || replace(sheet, 'PLAN_', '') || '-' || (row_no - 2) AS feature_id, (row_no - 2)::BIGINT AS feature_seq, code, kind, trim(flag) AS flag FROM {_ITEMS} WHERE sheet <> 'L_TYPE'""")
def sheet_features(spark, d):
    props = F.col("props")
    kind = F.when(F.col("layer") == "CABLE", F.try_element_at(props, F.lit("TYPE_CABLE"))).otherwise(F.try_element_at(props, F.lit("TYPE")))
    return S.sheets_to_features(_item_sheets(spark, d)).select("project_id", "layer", "source_layer", "feature_id", "feature_seq", F.try_element_at(props, F.lit("CODE")).alias("code"), kind.alias("kind"), F.try_element_at(props, F.lit("STATUT")).alias("flag"))


@query("""WITH r AS (SELECT conv_id::VARCHAR AS sheet, turn::INTEGER AS row_no, trim(replace(coalesce(text, ''), chr(10), ' ')) AS item, CASE WHEN turn % 3 = 0 THEN 'R' || turn ELSE '' END AS no FROM conversations)
SELECT sheet, row_no, coalesce(last_value(nullif(no, '') IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no, item ROWS UNBOUNDED PRECEDING), '') AS no, item AS check_item, 2::INTEGER AS n_layers FROM r QUALIFY item <> ''""")
def validation_rules(spark, d):
    c = _t(spark, d, "conversations")
    cells = F.array(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("R"), F.col("turn").cast("string"))).otherwise(""), F.lit(""), F.coalesce("text", F.lit("")), F.lit(""), F.lit(" A  B "), F.lit("x, y"), F.lit(""))
    sheets = c.select(F.lit("p").alias("project_id"), F.lit("f").alias("file"), F.col("conv_id").cast("string").alias("sheet"), F.col("turn").cast("int").alias("row_no"), cells.alias("cells"))
    return S.parse_validation_rules(sheets).select("sheet", "row_no", "no", "check_item", F.size("layers").alias("n_layers"))


@query("""SELECT p_brand AS sheet, row_no::INTEGER AS row_no, p_name AS name, p_type AS desc_fr, 'max ' || p_size AS length, (CASE WHEN upper(p_name[1:10]) = 'CABLE_AMON' THEN 30 ELSE p_size END)::INTEGER AS max_length
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row_no FROM part) WHERE trim(p_name) <> ''""")
def field_specs(spark, d):
    from pyspark.sql.window import Window

    part = _t(spark, d, "part").withColumn("row_no", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1)
    rows = part.select(F.lit("p").alias("project_id"), F.lit("f").alias("file"), F.col("p_brand").alias("sheet"), "row_no", F.array("p_name", F.concat(F.lit("max "), F.col("p_size").cast("string")), F.col("p_type")).alias("cells"))
    heads = part.select("p_brand").distinct().select(F.lit("p").alias("project_id"), F.lit("f").alias("file"), F.col("p_brand").alias("sheet"), F.lit(1).alias("row_no"), F.array(*map(F.lit, ("Nom champ", "Longueur champ", "Descriptif"))).alias("cells"))
    return S.parse_field_specs(rows.unionByName(heads)).select("sheet", "row_no", "name", "desc_fr", "length", "max_length")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS postal, p_brand AS cut, p_size::VARCHAR AS fibres FROM part""")
def truncated_fields(spark, d):
    even = F.col("p_size") % 2 == 0
    props = F.map_concat(F.create_map(F.lit("CODE_POSTA"), "p_brand", F.lit("NB_FIBRE_U"), F.col("p_size").cast("string")), F.when(even, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("CODE_POSTAL"), F.col("p_type"))))
    m = F.col("m")
    return _t(spark, d, "part").select("p_partkey", S.complete_truncated_fields(props).alias("m")).select("p_partkey", m["CODE_POSTAL"].alias("postal"), m["CODE_POSTA"].alias("cut"), m["NB_FIBRE_UTIL"].alias("fibres"))


def _part_features(spark, d):
    """Parts as features: the project is the brand, the layer one of several, of which some are official ones."""
    layers = F.array(*map(F.lit, ("CABLE_A", "CABLE_B", "BOITE", "PTECH_1", "LABEL")))
    k = (F.col("p_partkey") % 5).cast("int")
    props = F.create_map(F.lit("CODE"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")), F.lit("CAPACITE"), (F.col("p_size") / 2).cast("string"), F.lit("TYPE"), "p_type", F.lit("REUSE"), F.when(F.col("p_size") > 25, "Oui").otherwise(" "))
    return _t(spark, d, "part").select(F.col("p_brand").alias("project_id"), F.get(layers, k).alias("layer"), k.alias("layer_order"), F.col("p_partkey").cast("string").alias("feature_id"), props.alias("props"))


_PARTS = "(SELECT *, p_brand AS project_id, ['CABLE_A', 'CABLE_B', 'BOITE', 'PTECH_1', 'LABEL'][p_partkey % 5 + 1] AS layer, p_partkey % 5 AS layer_order FROM part)"


@query(f"""WITH p AS {_PARTS}, f AS (SELECT *, CASE WHEN layer[1:5] = 'CABLE' THEN 'cable' WHEN layer = 'BOITE' THEN 'boite' WHEN layer = 'PTECH_1' THEN 'ptech' END AS object_type FROM p),
g AS (SELECT *, min(layer_order) OVER (PARTITION BY project_id, object_type) AS best FROM f WHERE object_type IS NOT NULL)
SELECT project_id, object_type, object_type || ':C' || p_partkey AS id, 'C' || p_partkey AS code, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2)::VARCHAR END AS capacite, p_type AS type, CASE WHEN p_size > 25 THEN 'yes' END AS reuse FROM g WHERE layer_order = best""")
def engineering_objects(spark, d):
    return S.engineering_objects(_part_features(spark, d)).select("project_id", "object_type", "id", "code", "capacite", "type", "reuse")


@query(f"""WITH p AS {_PARTS}, g AS (SELECT *, min(layer_order) OVER (PARTITION BY project_id) AS best FROM p WHERE contains(layer, 'CABLE')) SELECT project_id, layer, p_partkey::VARCHAR AS feature_id FROM g WHERE layer_order = best""")
def match_layer(spark, d):
    return S.match_layer(_part_features(spark, d), "cable").select("project_id", "layer", "feature_id")


@query(f"""WITH p AS {_PARTS} SELECT project_id, p_partkey::VARCHAR AS feature_id, layer AS source_layer, 'C' || p_partkey AS code, p_size / 2 AS capacity FROM p WHERE layer = 'BOITE' OR (layer = 'LABEL' AND project_id NOT IN (SELECT project_id FROM p WHERE layer = 'BOITE'))""")
def to_entity(spark, d):
    return S.to_entity(_part_features(spark, d), "BOITE", {"code": ("code", "string"), "capacity": ("Capacite", "double")}, ("LABEL",)).select("project_id", "feature_id", "source_layer", "code", "capacity")


@query(f"""WITH p AS {_PARTS}, s AS (SELECT project_id, base, 4 - count(DISTINCT suffix) AS missing FROM (SELECT p_brand AS project_id, (p_partkey // 3)::VARCHAR AS base, ['shp', 'shx', 'dbf', 'prj'][p_size % 4 + 1] AS suffix FROM part) GROUP BY 1, 2 HAVING bool_or(suffix = 'shp'))
SELECT project_id, count(DISTINCT layer) AS n_layers, count(*) AS n_objects, count(*) FILTER (contains(layer, 'CABLE')) AS n_cables, coalesce((SELECT sum(missing) FROM s WHERE s.project_id = p.project_id), 0)::BIGINT AS missing FROM p GROUP BY project_id""")
def pipeline_summary(spark, d):
    suffix = F.get(F.array(*map(F.lit, ("shp", "shx", "dbf", "prj"))), (F.col("p_size") % 4).cast("int"))
    base = F.floor(F.col("p_partkey") / 3).cast("string")
    manifest = _t(spark, d, "part").select(F.col("p_brand").alias("project_id"), suffix.alias("suffix"), F.concat_ws(".", base, suffix).alias("name"))
    return S.pipeline_summary(_part_features(spark, d), manifest)


@query("""SELECT coalesce(b.section, o.section) AS section, coalesce(b.key, o.key) AS key, coalesce(o.value, b.value) AS value FROM (SELECT c_nationkey AS section, c_custkey AS key, c_mktsegment AS value FROM customer) b
FULL JOIN (SELECT s_nationkey AS section, s_suppkey AS key, s_name AS value FROM supplier) o ON o.section = b.section AND o.key = b.key""")
def merge_params(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return S.merge_params(c.select(F.col("c_nationkey").alias("section"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), s.select(F.col("s_nationkey").alias("section"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")))


@query("""WITH i AS (SELECT ['R005', 'R010', 'R019', 'R001', 'R033'][o_orderkey % 5 + 1] AS r, o_orderkey::VARCHAR AS o, o_orderpriority AS m FROM orders) SELECT o AS object_id, 'rule ' || r || ': ' || o || ' - ' || m AS blocking_reason,
CASE r WHEN 'R005' THEN 'check that CODE, ORIGINE and EXTREMITE of ' || o || ' agree with the device layers: ' || m WHEN 'R010' THEN 'check that the geometry of ' || o || ' lies on its devices: ' || m WHEN 'R019' THEN 'check the capacity or the references of ' || o || ': ' || m
WHEN 'R001' THEN 'check that the files are complete and the layers named by the rules: ' || m ELSE 'mend ' || o || ': ' || m END AS fix_suggestion FROM i""")
def fix_suggestions(spark, d):
    rules = F.array(*map(F.lit, ("R005", "R010", "R019", "R001", "R033")))
    issues = _t(spark, d, "orders").select(F.get(rules, (F.col("o_orderkey") % 5).cast("int")).alias("rule_id"), F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_orderpriority").alias("message"))
    return S.with_suggestion(issues).select("object_id", "blocking_reason", "fix_suggestion")


@query("""SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS code, p_type AS procedure, p_name AS location, p_name AS name, p_brand AS unit FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey""")
def construction_join(spark, d):
    li, p = _t(spark, d, "lineitem", "part")
    materials = p.where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_type").alias("procedure"), F.col("p_name").alias("location"), F.col("p_name").alias("name"), F.col("p_brand").alias("unit"))
    return S.construction_join(li.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("code")), materials)


#: A case a nation: boxes are its customers, cables its suppliers' line items, the bill their parts, cores their splits.
_CASE = """WITH s AS (SELECT s_suppkey, s_nationkey AS n FROM supplier), li AS (SELECT n::VARCHAR AS project_id, l_orderkey || '-' || l_linenumber AS code, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line FROM lineitem JOIN s ON s_suppkey = l_suppkey),
b AS (SELECT c_nationkey::VARCHAR AS project_id, c_custkey::VARCHAR AS code FROM customer), e AS (SELECT project_id, code, unnest([part::VARCHAR, 'pop' || line]) AS ref FROM li), held AS (SELECT project_id, 'BOITE' AS sheet FROM b UNION SELECT project_id, unnest(['CABLE', 'BOM物料', '纤芯连接与分配']) FROM li),
p AS (SELECT DISTINCT project_id FROM held), i AS (SELECT project_id, 'R-FILE-001' AS rule_id, w.sheet AS object FROM p, (SELECT unnest(['BOITE', 'CABLE', 'IMB', 'INFRASTRUCTURE', 'PTECH', 'SITE', 'ZNRO', 'ZPM', '纤芯连接与分配', 'BOM物料']) AS sheet) w WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.project_id = p.project_id AND h.sheet = w.sheet)
UNION ALL SELECT project_id, 'R-FLD-002', 'CABLE CODE=' || code FROM (SELECT project_id, code, unnest(range(1, count(*))) FROM li GROUP BY 1, 2)
UNION ALL SELECT project_id, 'R-REL-004', 'CABLE ' || code FROM e WHERE ref[1:3] <> 'pop' AND NOT EXISTS (SELECT 1 FROM b WHERE b.project_id = e.project_id AND b.code = e.ref)
UNION ALL SELECT project_id, 'R-REL-001', 'BOITE ' || code FROM b WHERE EXISTS (SELECT 1 FROM li WHERE li.project_id = b.project_id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.project_id = b.project_id AND e.ref = b.code)
UNION ALL SELECT project_id, 'R-DAT-001', supp || '/' || line || '/1:8' FROM li GROUP BY project_id, supp, line HAVING count(DISTINCT part % 16) > 8
UNION ALL SELECT project_id, 'R-BOM-001', 'BOM ' || part FROM li WHERE part NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40))
SELECT project_id, rule_id, object, count(*) AS n FROM i GROUP BY 1, 2, 3"""


@query(_CASE)
def case_check(spark, d):
    c, li, s, p = _t(spark, d, "customer", "lineitem", "supplier", "part")
    line = ("l_orderkey", "l_linenumber")
    li = li.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", *line, "l_partkey", "l_suppkey")
    # a nation is a large group: its lines are numbered once, by a range sort, for the three sheets that they fill
    li, c = N.numbered(li, ["s_nationkey"], line), N.numbered(c.select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"])
    rows = lambda df, key, sheet, cells: df.select(F.col(key).cast("string").alias("project_id"), F.lit(sheet).alias("sheet"), (F.col("row_no") + 1).alias("row_no"), F.array(*[x.cast("string") for x in cells]).alias("cells"))
    nations = {key: cut(df.select(F.col(key).cast("string").alias("project_id")).distinct()) for key, df in (("c_nationkey", c), ("s_nationkey", li))}
    parts = [
        (c, "c_nationkey", "BOITE", [F.col("c_custkey")], ("CODE",)),
        (li, "s_nationkey", "CABLE", [F.concat_ws("-", *line), F.col("l_partkey"), F.concat(F.lit("pop"), F.col("l_linenumber").cast("string"))], ("CODE", "ORIGINE", "EXTREMITE")),
        (li, "s_nationkey", "BOM物料", [F.col("l_partkey")], ("物料编码",)),
        (li, "s_nationkey", "纤芯连接与分配", [F.col("l_suppkey"), F.col("l_linenumber"), F.lit("1:8"), F.lit("i"), F.col("l_partkey") % 16], ("所属节点", "托盘编号", "光分路器", "IN", "OUT")),
    ]
    sheets = None
    for df, key, sheet, cells, names in parts:
        head = nations[key].select("project_id", F.lit(sheet).alias("sheet"), F.lit(1).cast("bigint").alias("row_no"), F.array(*map(F.lit, names)).alias("cells"))
        both = rows(df, key, sheet, cells).unionByName(head)
        sheets = both if sheets is None else sheets.unionByName(both)
    known = p.where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("code"))
    return S.check_case(sheets, known).groupBy("project_id", "rule_id", "object").agg(F.count("*").alias("n"))


# Pairs of geometries


@query(f"""WITH r AS ({_RECT}), p AS (SELECT vec_id, layer, e[1] AS x, e[2] AS y FROM ({_E})) SELECT 'within' AS relation, p.layer, p.vec_id AS a_id, r.vec_id AS b_id FROM p JOIN r ON r.layer = p.layer AND x > x0 AND x < x1 AND y > y0 AND y < y1
UNION ALL SELECT 'intersects', a.layer, a.vec_id, b.vec_id FROM r a JOIN r b ON a.layer = b.layer AND least(a.x1, b.x1) >= greatest(a.x0, b.x0) AND least(a.y1, b.y1) >= greatest(a.y0, b.y0)""")
def spatial_pairs(spark, d):
    rects = _rectangles(spark, d).select("layer", "vec_id", F.lit("polygon").alias("geom_type"), "coords")
    points = _features(spark, d).select("layer", "vec_id", F.lit("point").alias("geom_type"), F.slice("coords", 1, 1).alias("coords"))
    inside = G.spatial_pairs(points, rects, "within", 0.2, ["layer"], "vec_id").select(F.lit("within").alias("relation"), "layer", "a_id", "b_id")
    return inside.unionByName(G.spatial_pairs(rects, rects, "intersects", 0.2, ["layer"], "vec_id").select(F.lit("intersects").alias("relation"), "layer", "a_id", "b_id"))


_FRAME = f"SELECT vec_id, layer, x0, y0, x1, y1, x0 + 0.25 * (x1 - x0) AS hx0, y0 + 0.25 * (y1 - y0) AS hy0, x1 - 0.25 * (x1 - x0) AS hx1, y1 - 0.25 * (y1 - y0) AS hy1 FROM ({_RECT})"


def _common(a: str, b: str) -> str:
    """SQL for the area that two boxes share."""
    side = lambda v: f"greatest(0.0, least(a.{a}{v}1, b.{b}{v}1) - greatest(a.{a}{v}0, b.{b}{v}0))"
    return f"{side('x')} * {side('y')}"


def _frames(spark, d):
    """Zones with a hole in the middle and slanted sides: a box without its middle quarter, moved to the right by half of its height."""
    rects = _rectangles(spark, d).select("layer", "vec_id", geo.bbox(F.col("coords")).alias("b"))
    x0, y0, x1, y1 = (F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1"))
    at = lambda x, y: geo.xyz(x + y / 2, y)
    ring = lambda a, b, c, e: F.array(at(a, b), at(c, b), at(c, e), at(a, e))
    w, h = (x1 - x0) / 4, (y1 - y0) / 4
    return rects.select("layer", "vec_id", F.lit("polygon").alias("geom_type"), F.array(ring(x0, y0, x1, y1), ring(x0 + w, y0 + h, x1 - w, y1 - h)).alias("coords"))


@query(f"""WITH f AS ({_FRAME}), s AS (SELECT a.layer, a.vec_id AS a_id, b.vec_id AS b_id, {_common('', '')} - {_common('h', '')} - {_common('', 'h')} + {_common('h', 'h')} AS area
FROM f a JOIN f b ON a.layer = b.layer AND a.vec_id < b.vec_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT layer, a_id, b_id, round(area, 6) AS area FROM s WHERE area > 1e-9""")
def ring_overlaps(spark, d):
    return G.overlaps(_frames(spark, d), 0.2, ["layer"], "vec_id").select("layer", "a_id", "b_id", V.rounded(F.col("area"), 6).alias("area"))


@query(f"""WITH f AS ({_FRAME}), p AS (SELECT vec_id, layer, e[1] AS x, e[2] AS y FROM ({_E})) SELECT p.layer, p.vec_id FROM p WHERE NOT EXISTS (SELECT 1 FROM f
WHERE f.layer = p.layer AND x > x0 AND x < x1 AND y > y0 AND y < y1 AND NOT (x >= hx0 AND x <= hx1 AND y >= hy0 AND y <= hy1))""")
def ring_coverage(spark, d):
    points = _features(spark, d, 2).select("layer", "vec_id", (F.col("x") + F.col("y") / 2).alias("x"), "y")
    return G.outside(points, _frames(spark, d), 0.2, ["layer"], "vec_id").select("layer", "vec_id")
