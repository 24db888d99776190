"""Queries that bind the audit's newer operators to the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netaudit.driver_queries import _t, query
from netaudit.operators import joins as J
from netaudit.operators import ranks as N
from netaudit.operators import spatial as G
from netaudit.operators.aggregates import distance_stats
from netaudit.plans import rules as R
from netaudit.plans.audit import objects_of, trace_objects
from netaudit.schema import FEATURES
from netaudit.sources import readers
from netaudit.streaming.submissions import dedupe_batch


def _as_features(rows, layer: str, project, seq: str, props: dict, geometry=None):
    """Rows of a table as features of one layer."""
    from netaudit.functions import geo

    texts = F.map_filter(F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    kinds = F.create_map(*[x for k in props for x in (F.lit(k), F.lit("string"))])
    kind, coords = geometry or (F.lit(None).cast("string"), F.lit(None).cast(geo.COORDS))
    columns = {
        "project_id": project.cast("string"), "layer": F.lit(layer), "layer_order": F.lit(0), "feature_id": F.col(seq).cast("string"), "feature_seq": F.col(seq).cast("long"),
        "geom_type": kind, "coords": coords, "crs": F.lit("EPSG:4326"), "props": texts, "prop_types": kinds, "is_deleted": F.lit(False),
    }
    return rows.select(*[columns[f.split(" ")[0]].alias(f.split(" ")[0]) for f in FEATURES.split(", ")])


def _network(spark, d):
    """Orders as cables between boxes, parts as boxes."""
    o, p = _t(spark, d, "orders", "part")
    code = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    cables = _as_features(o, "CABLE", F.col("o_custkey") % 7, "o_orderkey", {
        "CODE": code("C-", "o_orderkey"), "ORIGINE": F.concat(F.lit("B-"), F.col("o_custkey") % 50), "EXTREMITE": F.concat(F.lit("B-"), F.col("o_orderkey") % 50),
        "NB_FIBRE_U": F.col("o_orderkey") % 40, "CAPACITE": F.col("o_custkey") % 30, "PRIORITE": F.col("o_orderpriority"),
    })
    boxes = _as_features(p, "BOITE", F.col("p_partkey") % 7, "p_partkey", {
        "CODE": code("B-", "p_partkey"), "TYPE": F.when(F.col("p_partkey") % 3 > 0, "PBO").otherwise("BPE"), "NB_FIBRE_UTIL": F.col("p_size"), "CAPACITE": F.concat((F.col("p_partkey") % 60).cast("string"), F.lit("FO")),
        "NAME": F.col("p_name"),
    })
    return cables.unionByName(boxes)


_NETWORK = """(SELECT (o_custkey % 7)::VARCHAR AS project_id, 'CABLE' AS layer, 'C-' || o_orderkey AS code, 'B-' || o_custkey % 50 AS a, 'B-' || o_orderkey % 50 AS b, (o_orderkey % 40)::DOUBLE AS used, (o_custkey % 30)::DOUBLE AS held,
'' AS kind, o_orderpriority AS name FROM orders UNION ALL
SELECT (p_partkey % 7)::VARCHAR, 'BOITE', 'B-' || p_partkey, NULL, NULL, p_size, p_partkey % 60, CASE WHEN p_partkey % 3 > 0 THEN 'PBO' ELSE 'BPE' END, p_name FROM part)"""


@query(f"""WITH n AS {_NETWORK}
SELECT project_id, 'R-GIS-005' AS rule_id, a AS object_id, NULL AS field, false AS passed, 'logic' AS of FROM n WHERE layer = 'CABLE' AND a = b
UNION ALL SELECT project_id, 'R012', code, NULL, false, (used * 1000 + held)::BIGINT::VARCHAR FROM n WHERE layer = 'CABLE' AND used > held
UNION ALL SELECT project_id, 'R020', code, NULL, false, (used * 1000 + held)::BIGINT::VARCHAR FROM n WHERE kind = 'PBO' AND used > held
UNION ALL SELECT project_id, 'R007_1', code, NULL, used <= held, (used * 1000 + held)::BIGINT::VARCHAR FROM n WHERE kind = 'PBO' AND used IS NOT NULL
UNION ALL SELECT project_id, 'R032', code, CASE layer WHEN 'CABLE' THEN 'PRIORITE' ELSE 'NAME' END, false, name FROM n WHERE length(trim(name)) > CASE layer WHEN 'CABLE' THEN 6 ELSE 10 END""")
def row_rules(spark, d):
    """Rules on single features, all in one projection over one scan."""
    specs = [("CABLE", "PRIORITE", "Texte", 6), ("BOITE", "NAME", "Texte", 10)]
    found = R.run_all(R.Context(_network(spark, d)), ["R-GIS-005", "R012", "R020", "R007_1", "R032"], {"R032": {"specs": specs}})
    both = (F.col("actual_value").try_cast("double") * 1000 + F.col("expected_value").try_cast("double")).cast("bigint").cast("string")
    of = F.when(F.col("rule_id") == "R-GIS-005", "logic").when(F.col("rule_id") == "R032", F.col("actual_value")).otherwise(both)
    return found.select("project_id", "rule_id", "object_id", "field", "passed", of.alias("of"))


@query(f"""WITH n AS {_NETWORK}, o AS (SELECT project_id, upper(code) AS code, max(layer || ':' || substr(code, 3)) AS ref FROM n GROUP BY 1, 2),
i AS (SELECT (o_custkey % 7)::VARCHAR AS project_id, o_orderkey, 'order ' || o_orderstatus || ' needs b-' || o_custkey || ' and c-' || (o_orderkey + 3) AS message FROM orders)
SELECT i.project_id, o_orderkey, arg_min(ref, (-length(code), code)) AS object_ref FROM i LEFT JOIN o ON o.project_id = i.project_id AND contains(upper(message), code) GROUP BY 1, 2""")
def traced_issues(spark, d):
    """Issues traced to the object with the longest code that their text contains; codes are prefixes of each other."""
    said = F.format_string("order %s needs b-%d and c-%d", "o_orderstatus", "o_custkey", F.col("o_orderkey") + 3)
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 7).cast("string").alias("project_id"), F.col("o_orderkey").cast("string").alias("code"), said.alias("said"))
    issues = R.issues(rows, "R008", "ORDER", F.col("said"), object_id=F.lit(None).cast("string"), actual=F.col("code"))
    return trace_objects(issues, objects_of(_network(spark, d))).select("project_id", F.col("actual_value").cast("long").alias("o_orderkey"), "object_ref")


_PLACES = "(SELECT c_custkey AS id, 'c' || c_nationkey AS code, (c_custkey * 7919 % 36000) / 100.0 - 180 AS x, (c_custkey * 104729 % 17000) / 100.0 - 85 AS y FROM customer)"


@query(f"""WITH p AS {_PLACES}, d AS (SELECT a.id, radians((a.y + b.y) / 2) AS mid, radians(b.y - a.y) AS dy, radians((((b.x - a.x + 180) % 360) + 360) % 360 - 180) AS dx FROM p a JOIN p b ON a.code <> b.code),
w AS (SELECT *, 1 - 0.0066943799901413165 * sin(mid) ** 2 AS w FROM d)
SELECT id, round(min(sqrt((6378137.0 * (1 - 0.0066943799901413165) / w ** 1.5 * dy) ** 2 + (6378137.0 / sqrt(w) * cos(mid) * dx) ** 2)), 2) AS metres FROM w GROUP BY id""")
def nearest_in_metres(spark, d):
    """The nearest place of another code on the whole earth, near the poles and across the 180th meridian too."""
    c = _t(spark, d, "customer")
    places = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), "c_nationkey").alias("code"), ((F.col("c_custkey") * 7919 % 36000) / 100.0 - 180).alias("x"), ((F.col("c_custkey") * 104729 % 17000) / 100.0 - 85).alias("y"))
    return G.nearest_on_earth(places, [], ["id"], "code", 20_000.0).select("id", F.round("d", 2).alias("metres"))


@query("""SELECT o_orderpriority, count(*) AS n, round(min(d), 3) AS least, round(quantile_cont(d, 0.5), 3) AS median, round(max(d), 3) AS most FROM (SELECT o_orderpriority, o_totalprice - c_acctbal AS d FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def distance_stats_by_group(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    edges = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderpriority", (F.col("o_totalprice") - F.col("c_acctbal")).alias("d"))
    return distance_stats(edges, "d", ["o_orderpriority"])


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_suppkey) AS of FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)""")
def row_numbers(spark, d):
    rows = _t(spark, d, "lineitem")
    return N.numbered(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "place", "of").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "place", "of")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (WITH RECURSIVE p AS (SELECT user_id, event_type, event_id, ts, k FROM e WHERE k = 1 UNION ALL
SELECT n.user_id, n.event_type, n.event_id, n.ts, n.k FROM p, LATERAL (SELECT * FROM e WHERE e.user_id = p.user_id AND e.event_type = p.event_type AND e.k > p.k AND e.ts >= p.ts + INTERVAL 12 HOUR ORDER BY e.k LIMIT 1) n) SELECT * FROM p)
SELECT event_id, user_id, event_type FROM r""")
def submissions_by_hours(spark, d):
    """Events that pass as submissions if none of their content has passed within twelve hours."""
    return dedupe_batch(_t(spark, d, "events"), "ts", ["user_id", "event_type"], 12.0).select("event_id", "user_id", "event_type")


@query("""WITH r AS (SELECT l_suppkey::VARCHAR AS sheet, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) + 1 AS row_no, l_partkey::VARCHAR AS part, l_returnflag AS flag FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row_no) AS place, count(*) OVER (PARTITION BY sheet) AS total FROM r WHERE contains(part, '7') OR contains(lower(flag), '7')) SELECT sheet, row_no::INTEGER AS row_no, part, place, total FROM f WHERE place BETWEEN 11 AND 20""")
def sheet_page(spark, d):
    """The second page of ten of each sheet's rows that hold a word, below the detected header."""
    from pyspark.sql.window import Window

    rows = _t(spark, d, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    body = rows.select(F.col("l_suppkey").cast("string").alias("sheet"), (nth + 1).cast("int").alias("row_no"), F.array(F.col("l_partkey").cast("string"), "l_returnflag").alias("cells"))
    heads = rows.select(F.col("l_suppkey").cast("string").alias("sheet")).distinct().select("sheet", F.lit(1).alias("row_no"), F.array(F.lit("part"), F.lit("flag")).alias("cells"))
    sheets = heads.unionByName(body).select(F.lit("p").alias("project_id"), F.lit("f").alias("file"), "sheet", "row_no", "cells")
    return readers.sheet_pages(sheets, 2, 10, "7").select("sheet", "row_no", F.col("record")["part"].alias("part"), "place", "total")


@query("""WITH d AS (SELECT DISTINCT n_name AS e FROM nation UNION SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey % 2 = 0), v AS (SELECT DISTINCT p_name AS value FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT c_mktsegment || ' ' || c_name FROM customer UNION SELECT o_orderpriority FROM orders)
SELECT value FROM v WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(upper(value), upper(e)) OR contains(upper(e), upper(value)) OR split_part(upper(value), ' ', 1) = split_part(upper(e), ' ', 1))""")
def domain_list(spark, d):
    """Values that a list of any size doesn't know, without a nested loop."""
    n, c, p, o = _t(spark, d, "nation", "customer", "part", "orders")
    entries = n.select(F.col("n_name").alias("e")).union(c.where("c_nationkey % 2 = 0").select("c_mktsegment")).distinct()
    values = p.select(F.col("p_name").alias("v")).union(p.select("p_type")).union(c.select(F.concat_ws(" ", "c_mktsegment", "c_name"))).union(o.select("o_orderpriority"))
    return J.in_domain(values, "v", entries, "e")
