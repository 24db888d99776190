"""Queries that bind the operators to the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netaudit.functions import geo
from netaudit.functions import values as V
from netaudit.operators import aggregates as A
from netaudit.operators import bom as B
from netaudit.operators import fields as C
from netaudit.operators import joins as J
from netaudit.operators import ranks as N
from netaudit.operators import spatial as G
from netaudit.operators import windows as W
from netaudit.streaming.submissions import dedupe_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


# Joins


@query("SELECT l_orderkey AS ref, count(*) AS n FROM lineitem WHERE l_orderkey >= 10 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def orphan_refs(spark, d):
    li, o = _t(spark, d, "lineitem", "orders")
    return J.orphans(li.select("l_orderkey"), ["l_orderkey"], o.where("o_orderstatus = 'F'"), ["o_orderkey"], F.col("l_orderkey") < 10).groupBy(F.col("l_orderkey").alias("ref")).agg(F.count("*").alias("n"))


@query("""SELECT 'R009' AS rule_id, o_orderkey AS object_id, 'warning' AS severity, 'logic_consistency' AS problem_category, false AS passed FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def isolated_objects(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    rule = F.lit("R009")
    return J.unreferenced(o.select("o_orderkey"), ["o_orderkey"], li, ["l_orderkey"]).select(rule.alias("rule_id"), F.col("o_orderkey").alias("object_id"), V.severity_of(rule).alias("severity"), V.category_of(rule).alias("problem_category"), F.lit(False).alias("passed"))


@query("""WITH l AS (SELECT DISTINCT c_custkey::VARCHAR AS key FROM customer WHERE c_mktsegment = 'BUILDING'), r AS (SELECT DISTINCT o_custkey::VARCHAR AS key FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'left' AS side, key FROM l WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT 'right', key FROM r WHERE key NOT IN (SELECT key FROM l)""")
def bidir_coverage(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return J.bidirectional(c.where("c_mktsegment = 'BUILDING'"), ["c_custkey"], o.where("o_orderpriority = '1-URGENT'"), ["o_custkey"])


@query("""SELECT o_orderkey, c_name AS customer_c_name, n_name AS nation_n_name, round(o_totalprice - c_acctbal, 3) AS distance FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def edges_resolved(spark, d):
    return _edges(spark, d).select("o_orderkey", "customer_c_name", "nation_n_name", "distance")


def _edges(spark, d):
    o, c, n = _t(spark, d, "orders", "customer", "nation")
    up = J.resolve(o, {"customer": "o_custkey"}, c, "c_custkey", ["c_name", "c_nationkey", "c_acctbal"])
    both = J.resolve(up, {"nation": "customer_c_nationkey"}, n, "n_nationkey", ["n_name"])
    return both.withColumn("distance", F.round(F.col("o_totalprice") - F.col("customer_c_acctbal"), 3))


@query("""SELECT count(d) AS n, round(min(d), 3) AS least, round(quantile_cont(d, 0.5), 3) AS median, round(max(d), 3) AS most FROM (SELECT round(o_totalprice - c_acctbal, 3) AS d FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""")
def distance_stats(spark, d):
    return A.distance_stats(_edges(spark, d), "distance")


@query("""SELECT p_partkey, 'brand' AS side, p_brand AS ref FROM part WHERE trim(p_brand) <> '' UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE trim(p_type) <> '' UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part WHERE p_size IS NOT NULL""")
def unpivot_refs(spark, d):
    return J.unpivot_ends(_t(spark, d, "part"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")}, ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, p_name AS start_p_name, s_name AS end_s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE p_name IS NOT NULL OR s_name IS NOT NULL")
def both_ends(spark, d):
    li, p, s = _t(spark, d, "lineitem", "part", "supplier")
    out = J.resolve(J.resolve(li, {"start": "l_partkey"}, p, "p_partkey", ["p_name"]), {"end": "l_suppkey"}, s, "s_suppkey", ["s_name"])
    return out.where("start_p_name IS NOT NULL OR end_s_name IS NOT NULL").select("l_orderkey", "l_linenumber", "start_p_name", "end_s_name")


_DOMAIN = ("ECONOMY ANODIZED", "small", "STANDARD")


@query("""WITH d(x) AS (VALUES ('ECONOMY ANODIZED'), ('SMALL'), ('STANDARD')), v AS (SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL)
SELECT value FROM v WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(upper(trim(value)), x) OR contains(x, upper(trim(value))) OR split_part(upper(trim(value)), ' ', 1) = split_part(x, ' ', 1))""")
def domain_check(spark, d):
    return J.in_domain(_t(spark, d, "part"), "p_type", spark.createDataFrame([(x,) for x in _DOMAIN], "x string"), "x")


@query("SELECT p_partkey, p_brand AS code FROM part WHERE p_brand NOT IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6','Brand#7','Brand#8','Brand#9','Brand#10')")
def material_match(spark, d):
    known = spark.createDataFrame([(f"Brand#{k}",) for k in range(1, 11)], "code string")
    return J.orphans(_t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("code")), ["code"], known, ["code"])


@query("SELECT l_orderkey, l_linenumber, l_quantity AS needed, p_size::BIGINT AS held FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 0 AND l_quantity > p_size")
def capacity_match(spark, d):
    li, p = _t(spark, d, "lineitem", "part")
    return J.capacity_over(li, "l_partkey", F.col("l_quantity"), p, "p_partkey", V.first_digits(F.col("p_size").cast("string"))).select("l_orderkey", "l_linenumber", "needed", "held")


@query("""SELECT p_partkey AS code, p_size AS held, needed FROM part JOIN (SELECT l_partkey, max_by(l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity)) AS needed FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE needed > 0 AND p_size < needed""")
def coverage_last(spark, d):
    p, li = _t(spark, d, "part", "lineitem")
    return J.coverage(p, "p_partkey", F.col("p_size"), li, "l_partkey", F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"])


@query("SELECT p_partkey AS code, p_size AS held, needed FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS needed FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE needed > 0 AND p_size < needed")
def coverage_sum(spark, d):
    p, li = _t(spark, d, "part", "lineitem")
    return J.coverage(p, "p_partkey", F.col("p_size"), li, "l_partkey", F.col("l_quantity"), [], how="sum")


@query("""WITH l AS (SELECT l_partkey, l_suppkey, l_orderkey AS code, l_orderkey * 1000 + l_linenumber AS seq FROM lineitem)
SELECT l_partkey, l_suppkey, a.code AS first, b.code AS second FROM l a JOIN l b USING (l_partkey, l_suppkey) WHERE a.seq < b.seq AND a.code <> b.code""")
def same_route_pairs(spark, d):
    li = _t(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    return J.same_route_pairs(li, ["l_partkey", "l_suppkey"], "l_orderkey", "seq")


@query("""SELECT doc_id, max_by(b.text, (length(b.text), b.text)) AS code FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id""")
def longest_code_in_text(spark, d):
    docs, b = _t(spark, d, "documents", "benchmark")
    return J.longest_in_text(docs, "doc_id", "text", b, "text", 4)


@query("SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS token FROM documents) WHERE token IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) FROM benchmark)")
def code_overlap(spark, d):
    docs, b = _t(spark, d, "documents", "benchmark")
    return J.shared_tokens(docs, "text", b, "text", "[A-Za-z]{4,}")


@query("""SELECT l_orderkey, l_linenumber, c_nationkey AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey""")
def self_loop(spark, d):
    li, o, c, s = _t(spark, d, "lineitem", "orders", "customer", "supplier")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return J.self_loops(rows, F.col("c_nationkey"), F.col("s_nationkey")).select("l_orderkey", "l_linenumber", F.col("c_nationkey").alias("nation"))


def _event_fields(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("event_type").alias("layer"), F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("field")).unionByName(e.select(F.col("event_type").alias("layer"), F.upper("event_type").alias("field")))


def _known_fields(spark):
    return spark.createDataFrame([(t, "KEY", "k") for t in ("click", "view")] + [(t, "PURCHASED", "purchased") for t in ("purchase", "error")] + [("click", "CLICKED", "clicks")], "layer string, official string, candidate string")


@query("""WITH f AS (SELECT event_type AS layer, unnest(json_keys(props)) AS field FROM events UNION SELECT event_type, upper(event_type) FROM events), k(layer, c) AS (VALUES ('click','K'),('view','K'),('purchase','PURCHASED'),('error','PURCHASED'),('click','CLICKS'))
SELECT DISTINCT layer, field FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.layer = f.layer AND k.c = upper(f.field))""")
def unmapped_fields(spark, d):
    return J.unmapped(_event_fields(spark, d), _known_fields(spark))


@query(None)
def field_suggestions(spark, d):
    return J.suggest(_event_fields(spark, d), _known_fields(spark), 0.82, 5)


# Aggregations and summaries


@query("SELECT code, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, lower(trim(text)) AS code FROM documents) GROUP BY code HAVING count(*) > 1")
def code_unique_all(spark, d):
    return A.repeated_codes(_t(spark, d, "documents"), F.lower(F.trim("text")), [], "doc_id")


@query("SELECT l_orderkey, l_linenumber AS code, count(*) AS n, min(l_partkey) AS first_id FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def code_unique_layer(spark, d):
    return A.repeated_codes(_t(spark, d, "lineitem"), F.col("l_linenumber"), ["l_orderkey"], "l_partkey")


_ROLLUP = """SELECT s_suppkey AS owner, coalesce(n, 0) AS needed, coalesce(h, 0)::BIGINT AS held, coalesce(n, 0) <= coalesce(h, 0) AS passed FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS n FROM lineitem WHERE {w} GROUP BY 1) ON s_suppkey = l_suppkey
LEFT JOIN (SELECT l_suppkey AS k, sum(p_size) AS h FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON s_suppkey = k"""


def _rollup(spark, d, where, skip):
    s, li, p = _t(spark, d, "supplier", "lineitem", "part")
    return A.rollup_over(s, "s_suppkey", li.where(where), "l_suppkey", F.col("l_quantity"), li.join(p, li.l_partkey == p.p_partkey), "l_suppkey", F.col("p_size"), skip)


@query(_ROLLUP.format(w="l_linenumber < 5"))
def port_rollup_a(spark, d):
    return _rollup(spark, d, "l_linenumber < 5", False)


@query(_ROLLUP.format(w="l_returnflag = 'R'") + " WHERE coalesce(n, 0) <> 0")
def port_rollup_b(spark, d):
    return _rollup(spark, d, "l_returnflag = 'R'", True)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > try_cast(nullif(regexp_extract(p_brand, '[0-9]+', 0), '') AS BIGINT)")
def usage_over(spark, d):
    li, p = _t(spark, d, "lineitem", "part")
    return A.over_limit(li.join(p, li.l_partkey == p.p_partkey), F.col("l_quantity"), V.first_digits(F.col("p_brand"))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey FROM part WHERE p_size > 24 + p_partkey % 12")
def core_over(spark, d):
    return A.over_limit(_t(spark, d, "part"), F.col("p_size"), 24 + F.col("p_partkey") % 12).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def limit_over(spark, d):
    return A.over_limit(_t(spark, d, "lineitem"), F.col("l_quantity"), F.lit(45)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_suppkey, count(DISTINCT l_partkey) AS n, max(l_linenumber) AS most FROM lineitem GROUP BY 1, 2 HAVING n > most")
def splitter_outputs(spark, d):
    return A.distinct_over(_t(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], "l_partkey", F.col("l_linenumber"))


# Geometry from embeddings: point (e1, e2), line of 32 vertices, rectangle around the first four; label is the layer


def _features(spark, d, every: int = 32) -> DataFrame:
    e = _t(spark, d, "embeddings").where("embedding IS NOT NULL").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    pts = F.transform(F.sequence(F.lit(0), F.lit(every - 1)), lambda k: geo.xyz(F.get("e", 2 * k), F.get("e", 2 * k + 1), F.get("e", F.pmod(3 * k, F.lit(64)))))
    kind = F.when(F.col("vec_id") % 3 == 0, "point").when(F.col("vec_id") % 3 == 1, "line").otherwise("polygon")
    crs = F.when(F.col("label") % 4 == 0, "EPSG:4490").otherwise("EPSG:4326")
    return e.select("vec_id", F.col("label").cast("string").alias("layer"), F.col("vec_id").alias("feature_seq"), kind.alias("geom_type"), crs.alias("crs"), "e", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"), pts.alias("coords"), "label")


def _rectangles(spark, d) -> DataFrame:
    f = _features(spark, d, 4)
    b = geo.bbox(F.col("coords"))
    ring = F.array(geo.xyz(b["x0"], b["y0"]), geo.xyz(b["x1"], b["y0"]), geo.xyz(b["x1"], b["y1"]), geo.xyz(b["x0"], b["y1"]))
    return f.select("vec_id", "layer", "label", ring.alias("coords"))


_E = "SELECT vec_id, label, label::VARCHAR AS layer, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL"
_RECT = f"SELECT vec_id, label, layer, least(e[1],e[3],e[5],e[7]) AS x0, greatest(e[1],e[3],e[5],e[7]) AS x1, least(e[2],e[4],e[6],e[8]) AS y0, greatest(e[2],e[4],e[6],e[8]) AS y1 FROM ({_E})"


@query("""WITH w(layer) AS (SELECT range::VARCHAR FROM range(12)), f AS (SELECT label::VARCHAR AS layer, vec_id, CASE vec_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END AS kind, CASE WHEN label % 4 = 0 THEN 'EPSG:4490' ELSE 'EPSG:4326' END AS crs FROM embeddings WHERE embedding IS NOT NULL)
SELECT layer, count(vec_id) AS n, min_by(kind, vec_id) AS kind, min_by(crs, vec_id) AS crs FROM w LEFT JOIN f USING (layer) GROUP BY layer""")
def layer_catalog(spark, d):
    return A.layer_catalog(_features(spark, d, 2), _wanted(spark))


def _wanted(spark):
    return spark.range(12).select(F.col("id").cast("string").alias("layer"))


@query("SELECT range::VARCHAR AS layer FROM range(12) WHERE range::VARCHAR NOT IN (SELECT label::VARCHAR FROM embeddings)")
def layer_empty(spark, d):
    return A.layer_catalog(_features(spark, d, 2), _wanted(spark)).where("n = 0").select("layer")


@query("""SELECT layer, kind, kind = 'point' AS passed FROM (SELECT label::VARCHAR AS layer, min_by(CASE vec_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END, vec_id) AS kind FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1)""")
def geom_kind(spark, d):
    return A.layer_catalog(_features(spark, d, 2), _wanted(spark)).where("n > 0").select("layer", "kind", (F.col("kind") == "point").alias("passed"))


@query("SELECT label::VARCHAR AS layer, CASE WHEN label % 4 = 0 THEN 'EPSG:4490' ELSE 'EPSG:4326' END AS crs FROM embeddings WHERE embedding IS NOT NULL AND label % 4 <> 0 GROUP BY 1, 2")
def crs_mix(spark, d):
    return A.layer_catalog(_features(spark, d, 2), _wanted(spark)).where("crs <> 'EPSG:4490'").select("layer", "crs")


# Issues of five fixed rules on the tables


def _issues(spark, d) -> DataFrame:
    o, c, p, li = _t(spark, d, "orders", "customer", "part", "lineitem")
    row = lambda df, rule, key, bad: df.select(F.lit(rule).alias("rule_id"), F.col(key).cast("string").alias("object_id"), (~bad).alias("passed"))
    parts = [row(o, "R007", "o_orderkey", F.col("o_totalprice") > 400000), row(c, "R019", "c_custkey", F.col("c_acctbal") < 4000), row(p, "R018", "p_partkey", F.col("p_size") > 40), row(o, "R-FIBER-001", "o_custkey", F.col("o_orderpriority") == "1-URGENT"), row(li, "R025", "l_partkey", F.col("l_discount") > 0.09)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.withColumn("severity", V.severity_of(F.col("rule_id"))).withColumn("problem_category", V.category_of(F.col("rule_id")))


_ISSUES = """(SELECT *, CASE rule_id WHEN 'R007' THEN 'fatal' WHEN 'R019' THEN 'error' WHEN 'R-FIBER-001' THEN 'error' ELSE 'warning' END AS severity, CASE rule_id WHEN 'R007' THEN 'data_completeness' WHEN 'R018' THEN 'data_completeness' WHEN 'R025' THEN 'spatial_safety' ELSE 'resource' END AS problem_category FROM (
SELECT 'R007' AS rule_id, o_orderkey::VARCHAR AS object_id, NOT o_totalprice > 400000 AS passed FROM orders UNION ALL SELECT 'R019', c_custkey::VARCHAR, NOT c_acctbal < 4000 FROM customer UNION ALL SELECT 'R018', p_partkey::VARCHAR, NOT p_size > 40 FROM part
UNION ALL SELECT 'R-FIBER-001', o_custkey::VARCHAR, NOT o_orderpriority = '1-URGENT' FROM orders UNION ALL SELECT 'R025', l_partkey::VARCHAR, NOT l_discount > 0.09 FROM lineitem))"""


@query(f"SELECT rule_id, count(*) AS total, count(*) FILTER (NOT passed AND severity = 'warning') AS warning, count(*) FILTER (NOT passed AND severity <> 'warning') AS failed, count(*) FILTER (passed) AS passed FROM {_ISSUES} GROUP BY rule_id")
def severity_counts(spark, d):
    return A.severity_counts(_issues(spark, d), ["rule_id"])


@query(f"SELECT problem_category, severity, count(*) AS n FROM {_ISSUES} WHERE NOT passed GROUP BY CUBE (problem_category, severity)")
def category_counts(spark, d):
    return A.category_counts(_issues(spark, d))


@query(f"""WITH i AS {_ISSUES}, s AS (SELECT rule_id, string_agg(object_id, ',' ORDER BY object_id) AS samples FROM (SELECT rule_id, object_id, row_number() OVER (PARTITION BY rule_id ORDER BY object_id) AS k FROM (SELECT DISTINCT rule_id, object_id FROM i WHERE NOT passed)) WHERE k <= 5 GROUP BY 1)
SELECT rule_id, count(*) AS total, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, count(*) FILTER (NOT passed AND severity <> 'warning') AS failed, coalesce(any_value(samples), '') AS samples FROM i LEFT JOIN s USING (rule_id) GROUP BY rule_id""")
def rule_summary(spark, d):
    return A.rule_summary(_issues(spark, d))


@query(f"""WITH i AS (SELECT *, count(*) FILTER (rule_id = 'R019') OVER () AS b FROM {_ISSUES} WHERE NOT passed), k AS (SELECT * FROM i WHERE severity = 'fatal' OR (rule_id = 'R019' AND b > 500))
SELECT rule_id, object_id, severity, count(*) OVER () AS "of" FROM k ORDER BY rule_id, object_id LIMIT 100""")
def serious_issues(spark, d):
    return A.serious_issues(_issues(spark, d), ["rule_id", "object_id"], objects=1000).select("rule_id", "object_id", "severity", "of")


@query("SELECT o_orderpriority AS layer, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)")
def device_stats(spark, d):
    return A.device_stats(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("layer")))


@query("SELECT round(avg(CASE WHEN c IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS c FROM documents JOIN benchmark b ON contains(documents.text, b.text)) ON d.doc_id = c")
def trace_rate(spark, d):
    docs, b = _t(spark, d, "documents", "benchmark")
    hit = J.longest_in_text(docs, "doc_id", "text", b, "text", 4)
    return docs.join(hit.select("doc_id", "code"), "doc_id", "left").agg(F.round(F.avg(F.when(F.col("code").isNotNull(), 1.0).otherwise(0.0)), 6).alias("rate"))


_HIT = "regexp_matches(text, '[#$%&*]{3}')"


@query(f"""WITH e AS (SELECT doc_id FROM labels WHERE quality = 0), h AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE {_HIT}), c AS (SELECT count(*) FILTER (e.doc_id IS NOT NULL AND h.doc_id IS NOT NULL) AS tp, count(*) FILTER (e.doc_id IS NULL) AS fp, count(*) FILTER (h.doc_id IS NULL) AS fn FROM e FULL JOIN h USING (doc_id))
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def accuracy(spark, d):
    docs, labels = _t(spark, d, "documents", "labels")
    return A.accuracy(labels.where("quality = 0"), docs.join(labels, "doc_id").where(F.col("text").rlike("[#$%&*]{3}")), ["doc_id"])


@query("SELECT count(*) AS wanted, count(h) AS had, round(count(h) / count(*), 6) AS share FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey AS h FROM orders WHERE o_orderstatus = 'F') ON c_custkey = h")
def rule_coverage(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return A.coverage_share(c, o.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(f"""SELECT rule_id, coalesce(got, 0) AS got, coalesce(n, 0) AS want FROM (SELECT rule_id, count(*) AS got FROM {_ISSUES} WHERE NOT passed GROUP BY 1) FULL JOIN (VALUES ('R007', 0), ('R018', 5), ('R999', 2)) e(rule_id, n) USING (rule_id) WHERE coalesce(got, 0) <> coalesce(n, 0)""")
def baseline_check(spark, d):
    return A.baseline_difference(_issues(spark, d).where("NOT passed"), spark.createDataFrame([("R007", 0), ("R018", 5), ("R999", 2)], "rule_id string, n long"))


# Fields


def _part_values(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.expr("nullif(p_name, 'small ring')").alias("p_name"), "p_brand", "p_type", F.col("p_size").alias("p_size"), "p_retailprice")
    return C.unpivot_fields(p, ["p_partkey"], ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@query("SELECT p_partkey, 'p_name' AS field FROM part WHERE p_name IS NULL OR p_name = 'small ring' OR trim(p_name) = '' UNION ALL SELECT p_partkey, 'p_brand' FROM part WHERE p_brand IS NULL OR trim(p_brand) = ''")
def required_not_empty(spark, d):
    return C.required_not_empty(_part_values(spark, d), spark.createDataFrame([("p_name",), ("p_brand",)], "field string")).select("p_partkey", "field")


@query("SELECT p_partkey, 'p_brand' AS field, 'string' AS kind FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'p_retailprice', 'double' FROM part WHERE p_retailprice IS NOT NULL")
def field_kind(spark, d):
    kinds = spark.createDataFrame([("p_brand", ["int", "bigint"]), ("p_size", ["int"]), ("p_retailprice", ["int"])], "field string, allowed array<string>")
    return C.wrong_kind(_part_values(spark, d), kinds).select("p_partkey", "field", "kind")


@query("""SELECT p_partkey, 'p_brand' AS field FROM part WHERE try_cast(p_brand AS DOUBLE) IS NULL UNION ALL SELECT p_partkey, 'p_retailprice' FROM part WHERE p_retailprice <> floor(p_retailprice)""")
def field_type(spark, d):
    specs = spark.createDataFrame([("p_brand", "Double"), ("p_size", "Entier"), ("p_retailprice", "Entier long"), ("p_name", "Texte")], "field string, type string")
    return C.wrong_type(_part_values(spark, d), specs).select("p_partkey", "field")


@query("SELECT p_partkey, 'p_name' AS field, length(trim(p_name))::INTEGER AS n FROM part WHERE p_name <> 'small ring' AND length(trim(p_name)) > 9 UNION ALL SELECT p_partkey, 'p_brand', length(p_brand)::INTEGER FROM part WHERE length(p_brand) > 7")
def field_length(spark, d):
    specs = spark.createDataFrame([("p_name", 9), ("p_brand", 7)], "field string, length int")
    return C.too_long(_part_values(spark, d), specs, F.col("kind").isin("int", "double")).select("p_partkey", "field", "n")


@query("""WITH p AS (SELECT DISTINCT p_type AS layer FROM part), s(field, type, length, required) AS (VALUES ('p_name','Texte',30,'O'),('p_size','Entier',NULL,'C'),('p_brand',NULL,10,'O'))
SELECT layer, field, 'required_not_empty' AS condition FROM p, s WHERE required = 'O' UNION ALL SELECT layer, field, 'field_type_check' FROM p, s WHERE type IS NOT NULL UNION ALL SELECT layer, field, 'field_length_check' FROM p, s WHERE length IS NOT NULL UNION ALL SELECT layer, 'p_partkey', 'unique' FROM p UNION ALL SELECT layer, 'p_name', 'manual_review' FROM p""")
def conditions(spark, d):
    layers = _t(spark, d, "part").select(F.col("p_type").alias("layer")).distinct()
    specs = spark.createDataFrame([("p_name", "Texte", 30, "O"), ("p_size", "Entier", None, "C"), ("p_brand", None, 10, "O")], "field string, type string, length int, required string")
    rules = spark.createDataFrame([("p_partkey", "code must be unique"), ("p_name", "ask someone")], "field string, text string")
    return C.derive_conditions(layers.crossJoin(F.broadcast(specs)), layers.crossJoin(F.broadcast(rules)))


# Windows and sheets


@query("""SELECT event_id, first_row FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, ts::DATE) AS first_row FROM events) WHERE event_id > first_row""")
def first_repeat(spark, d):
    e = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return W.repeat_of_first(e, ["user_id", "event_type", "day"], "event_id").select("event_id", "first_row")


def _sheets(spark, d):
    """Lines of documents as rows of sheets."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    return docs.select(F.col("source").alias("project_id"), F.col("doc_id").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("k", "line")).select("project_id", "sheet", (F.col("k") + 1).alias("row_no"), F.split("line", " ").alias("cells"))


_LINES = "(SELECT source AS project_id, doc_id AS sheet, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH t AS (SELECT sheet, row_no, list_filter(string_split(line, ' '), lambda c: trim(c) <> '') AS c FROM {_LINES} WHERE row_no <= 10), n AS (SELECT sheet, row_no, len(c) AS n, len(list_filter(c, lambda x: NOT regexp_matches(x, '[0-9]'))) AS t FROM t),
g AS (SELECT sheet, coalesce(max(n) FILTER (row_no = 1), 0) AS n1, max(n) AS nm, max(t) AS tm, arg_max(row_no, t * 100 - row_no) AS rt, arg_max(row_no, n * 100 - row_no) AS rn FROM n GROUP BY sheet)
SELECT sheet, (CASE WHEN n1 >= 5 OR n1 = nm THEN 1 WHEN tm >= 5 AND tm >= 2 * n1 THEN rt WHEN nm - n1 >= 5 AND nm >= 2 * n1 THEN rn ELSE 1 END)::INTEGER AS header_row FROM g""")
def detect_header(spark, d):
    return W.detect_header(_sheets(spark, d), ["sheet"], "row_no", "cells")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS head FROM conversations""")
def fill_down(spark, d):
    c = _t(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("text")))
    return W.fill_down(c, ["head"], ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "head")


@query("""SELECT o_orderpriority, o_orderkey, row_no, total FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER w AS row_no, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)) WHERE row_no BETWEEN 21 AND 40""")
def page_filter(spark, d):
    return N.page(_t(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], 2, 20, F.col("o_orderstatus") == "F").select("o_orderpriority", "o_orderkey", "row_no", "total")


@query("""WITH r AS (SELECT l_suppkey AS sheet, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) + 1 AS row_no, (l_partkey % 40)::VARCHAR AS a, l_returnflag AS b, (l_linenumber % 3)::VARCHAR AS c FROM lineitem)
SELECT sheet, row_no::INTEGER AS row_no, a || '/' || b || '/' || c AS core, first_row::INTEGER AS first_row FROM (SELECT *, min(row_no) OVER (PARTITION BY sheet, a, b, c) AS first_row FROM r) WHERE row_no > first_row""")
def fiber_shape_repeat(spark, d):
    from pyspark.sql.window import Window

    li = _t(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = li.select(F.lit("p").alias("project_id"), F.col("l_suppkey").alias("sheet"), (F.row_number().over(w) + 1).alias("row_no"), F.array((F.col("l_partkey") % 40).cast("string"), "l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("cells"))
    heads = li.select(F.lit("p").alias("project_id"), F.col("l_suppkey").alias("sheet")).distinct().select("*", F.lit(1).alias("row_no"), F.array(*map(F.lit, W.FIBER_SHAPES[1][0])).alias("cells"))
    return W.fiber_core_repeats(rows.unionByName(heads)).select("sheet", "row_no", "core", "first_row")


# Values


@query("""SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand || '-7', '[0-9]+', 0), '') AS BIGINT) AS first, try_cast(nullif(regexp_replace(p_brand || '-7', '[^0-9]', '', 'g'), '') AS BIGINT) AS every FROM part""")
def digits(spark, d):
    b = F.concat("p_brand", F.lit("-7"))
    return _t(spark, d, "part").select("p_partkey", V.first_digits(b).alias("first"), V.all_digits(b).alias("every"))


@query("SELECT p_partkey, length(regexp_replace(trim(p_retailprice::VARCHAR), '^(-?[0-9]+)\\.0+$', '\\1'))::INTEGER AS n FROM part")
def effective_length(spark, d):
    return _t(spark, d, "part").select("p_partkey", V.effective_length(F.col("p_retailprice").cast("string")).alias("n"))


_CODE = "'CDI-UNF-' || upper(replace(replace(c_name, 'Customer', 'C'), '#', '-'))"


@query(f"""SELECT c_custkey, CASE WHEN regexp_matches(code, r) THEN regexp_extract(code, r, 1) || '|' || regexp_extract(code, r, 2) || '|' || regexp_extract(code, r, 3) END AS parts FROM (SELECT c_custkey, {_CODE} AS code, '(?i)^([A-Z]{{2,6}})-([A-Z0-9]{{2,8}})-([A-Z0-9]{{1,60}}(?:-[A-Z0-9]{{1,60}})*)$' AS r FROM customer)""")
def code_template(spark, d):
    code = F.concat(F.lit("CDI-UNF-"), F.upper(F.replace(F.replace("c_name", F.lit("Customer"), F.lit("C")), F.lit("#"), F.lit("-"))))
    return _t(spark, d, "customer").select("c_custkey", F.array_join(V.match_code(code, V.GENERIC_CODE, 3), "|").alias("parts"))


@query("SELECT s_suppkey, CASE WHEN v LIKE '%1000%' THEN 1000 WHEN v LIKE '%750%' THEN 750 WHEN v LIKE '%500%' THEN 500 WHEN v LIKE '%330%' THEN 330 WHEN v LIKE '%220%' THEN 220 WHEN v LIKE '%110%' THEN 110 WHEN v LIKE '%35%' THEN 110 ELSE 10 END AS kv FROM (SELECT s_suppkey, (s_suppkey * 55)::VARCHAR || 'KV' AS v FROM supplier)")
def voltage_class(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", V.voltage_class(F.concat((F.col("s_suppkey") * 55).cast("string"), F.lit("KV"))).alias("kv"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), 'fiber|fibre|纤芯|core') THEN 'fiber' WHEN regexp_matches(lower(url), 'bom|物料|material|blog') THEN 'bom' ELSE 'other' END AS kind FROM (SELECT page_id, replace(url, 'blog', 'bom') AS url FROM pages)""")
def classify(spark, d):
    return _t(spark, d, "pages").select("page_id", V.classify_table(F.replace("url", F.lit("blog"), F.lit("bom"))).alias("kind"))


# Geometry


@query(f"SELECT vec_id, (k - 1)::INTEGER AS at, round(e[2*k-1], 6) AS x, round(e[2*k], 6) AS y FROM ({_E}), (SELECT range AS k FROM range(1, 33))")
def wkt_roundtrip(spark, d):
    f = _features(spark, d).select("vec_id", F.posexplode(geo.parse_wkt(geo.to_wkt("LINESTRING", F.col("coords")))).alias("at", "p"))
    return f.select("vec_id", "at", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"SELECT vec_id, round(list_min(e[1:63:2]), 6) AS x0, round(list_min(e[2:64:2]), 6) AS y0, round(list_max(e[1:63:2]), 6) AS x1, round(list_max(e[2:64:2]), 6) AS y1 FROM ({_E})")
def bbox(spark, d):
    b = geo.bbox(F.col("coords"))
    return _features(spark, d).select("vec_id", *[F.round(b[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_LEN = "list_sum(list_transform(range(1, 32), lambda k: sqrt(power(e[2*k+1] - e[2*k-1], 2) + power(e[2*k+2] - e[2*k], 2))))"


@query(f"SELECT vec_id, round({_LEN}, 5) AS length FROM ({_E})")
def line_length(spark, d):
    return _features(spark, d).select("vec_id", F.round(geo.line_length(F.col("coords")), 5).alias("length"))


def _dist_sql(x1, y1, x2, y2):
    w = f"(1 - 0.0066943799901413165 * power(sin(radians(({y1} + {y2}) / 2)), 2))"
    return f"sqrt(power(6378137.0 * (1 - 0.0066943799901413165) / power({w}, 1.5) * radians({y2} - {y1}), 2) + power(6378137.0 / sqrt({w}) * cos(radians(({y1} + {y2}) / 2)) * radians({x2} - {x1}), 2))"


@query(f"SELECT vec_id, round({_dist_sql('(-7 + e[1] / 100)', '(33 + e[2] / 100)', '(-7 + e[3] / 100)', '(33 + e[4] / 100)')}, 3) AS metres FROM ({_E})")
def dist_m(spark, d):
    at = lambda k: F.get("e", F.lit(k)) / 100
    return _features(spark, d, 2).select("vec_id", F.round(geo.dist_m(at(0) - 7, at(1) + 33, at(2) - 7, at(3) + 33, F.lit("EPSG:4326")), 3).alias("metres"))


@query(f"WITH f AS ({_E}) SELECT vec_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE sqrt(power(b.e[1] - a.e[63], 2) + power(b.e[2] - a.e[64], 2)) <= 0.01)")
def endpoint_on_point(spark, d):
    f = _features(spark, d)
    ends = f.select("vec_id", geo.last_vertex(F.col("coords")).alias("p")).select("vec_id", "p.x", "p.y")
    return G.without_near(ends, f.select("x", "y"), 0.01, [], ["vec_id"]).select("vec_id")


@query(f"""WITH f AS ({_E}) SELECT a.vec_id FROM f a JOIN f s ON s.vec_id = a.vec_id + 1 JOIN f t ON t.vec_id = a.vec_id + 2
WHERE NOT ((sqrt(power(s.e[1] - a.e[1], 2) + power(s.e[2] - a.e[2], 2)) <= 0.3 AND sqrt(power(t.e[1] - a.e[63], 2) + power(t.e[2] - a.e[64], 2)) <= 0.3) OR (sqrt(power(t.e[1] - a.e[1], 2) + power(t.e[2] - a.e[2], 2)) <= 0.3 AND sqrt(power(s.e[1] - a.e[63], 2) + power(s.e[2] - a.e[64], 2)) <= 0.3))""")
def endpoint_match(spark, d):
    f = _features(spark, d)
    lines = f.select("vec_id", "coords", (F.col("vec_id") + 1).alias("start_ref"), (F.col("vec_id") + 2).alias("end_ref"))
    return G.ends_match(lines, "start_ref", "end_ref", f.select(F.col("vec_id").alias("code"), "x", "y"), "code", 0.3, [], lambda a, b, c, e: F.hypot(c - a, e - b)).select("vec_id")


@query(f"""WITH f AS ({_E}), p AS (SELECT vec_id, label, 'start' AS side, e[1] AS x, e[2] AS y FROM f UNION ALL SELECT vec_id, label, 'end', e[63], e[64] FROM f)
SELECT a.vec_id, a.side, round(min(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))), 6) AS d FROM p a JOIN p b ON a.label <> b.label GROUP BY 1, 2 HAVING d > 0.02""")
def breakpoints(spark, d):
    ends = G.ends(_features(spark, d), ["vec_id", "label"])
    return G.nearest_other(ends, [], ["vec_id", "side"], "label", 0.02).select("vec_id", "side", F.round("d", 6).alias("d")).where("d > 0.02")


@query(f"WITH r AS (SELECT label, vec_id, x0, x1, y0, y1 FROM ({_RECT})) SELECT f.vec_id, r.vec_id AS zone FROM ({_E}) f JOIN r ON r.vec_id = f.label WHERE NOT (e[1] > x0 AND e[1] < x1 AND e[2] > y0 AND e[2] < y1)")
def point_in_zone(spark, d):
    zones = _rectangles(spark, d).withColumnRenamed("vec_id", "zone")
    out = G.point_not_in_own_zone(_features(spark, d, 2).select("vec_id", "x", "y", "label"), zones.select("zone", "coords"), "label", "zone", [])
    return out.select("vec_id", F.col("label").cast("bigint").alias("zone"))


@query(f"""WITH r AS (SELECT vec_id AS zone, x0, x1, y0, y1 FROM ({_RECT})), f AS (SELECT f.vec_id, len(list_filter(range(1, 33), lambda k: NOT (e[2*k-1] > x0 AND e[2*k-1] < x1 AND e[2*k] > y0 AND e[2*k] < y1)))::INTEGER AS n_outside FROM ({_E}) f JOIN r ON r.zone = f.label) SELECT * FROM f WHERE n_outside > 0""")
def cable_in_zone(spark, d):
    zones = _rectangles(spark, d).select(F.col("vec_id").alias("zone"), "coords")
    return G.vertices_outside(_features(spark, d).select("vec_id", "label", "coords"), zones, "label", "zone", []).select("vec_id", "n_outside")


@query(f"SELECT f.vec_id FROM ({_E}) f WHERE NOT EXISTS (SELECT 1 FROM ({_RECT}) r WHERE e[1] > x0 AND e[1] < x1 AND e[2] > y0 AND e[2] < y1)")
def coverage(spark, d):
    zones = _rectangles(spark, d).select("coords")
    return G.outside(_features(spark, d, 2).select("vec_id", "x", "y"), zones, 0.1, [], "vec_id").select("vec_id")


@query(f"""WITH r AS ({_RECT}) SELECT a.layer, a.vec_id AS a_id, b.vec_id AS b_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area FROM r a JOIN r b ON a.layer = b.layer AND a.vec_id < b.vec_id
WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1e-9""")
def zone_overlap(spark, d):
    return G.overlaps(_rectangles(spark, d), 0.2, ["layer"], "vec_id").select("layer", "a_id", "b_id", V.rounded(F.col("area"), 6).alias("area"))


@query(f"""WITH s AS (SELECT vec_id, layer, e[k] AS x1, e[k+1] AS y1, e[k+2] AS x2, e[k+3] AS y2 FROM ({_E}), (SELECT range AS k FROM range(1, 62, 2))), c AS (SELECT a.layer, a.vec_id AS a_id, b.vec_id AS b_id, (a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1) AS d, (b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1) AS t, (b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1) AS u FROM s a JOIN s b ON a.layer = b.layer AND a.vec_id < b.vec_id)
SELECT DISTINCT layer, a_id, b_id FROM c WHERE d <> 0 AND t / d > 0 AND t / d < 1 AND u / d > 0 AND u / d < 1""")
def line_crossing(spark, d):
    return _crossings(_features(spark, d))


def _crossings(f):
    return G.crossing_pairs(f, f, ["layer"], ("vec_id", "vec_id"), ordered=True)


@query(f"""WITH v AS (SELECT vec_id, label, e[2*k-1] AS x, e[2*k] AS y FROM ({_E}), (SELECT range AS k FROM range(1, 33))) SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(min(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))), 6) AS d FROM v a JOIN v b ON a.label = 0 AND b.label = 1 GROUP BY 1, 2 HAVING min(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))) < 0.02""")
def min_distance(spark, d):
    return _distances(_features(spark, d))


def _distances(f):
    return G.closer_than(f.where("label = 0"), f.where("label = 1"), 0.02, [], ("vec_id", "vec_id")).select("a_id", "b_id", V.rounded(F.col("d"), 6).alias("d"))


@query(f"""WITH v AS (SELECT vec_id, label, e[2*k-1] AS x, e[2*k] AS y FROM ({_E}), (SELECT range AS k FROM range(1, 33))), lim(label, kind, m) AS (VALUES (1, 'water', 0.03), (2, 'gas', 0.02))
SELECT a.vec_id AS a_id, b.vec_id AS b_id, kind, round(min(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))), 6) AS d FROM v a JOIN v b ON a.label = 0 JOIN lim ON b.label = lim.label GROUP BY 1, 2, 3, m HAVING min(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2))) < m""")
def utility_clearance(spark, d):
    return _clearances(spark, _features(spark, d))


def _clearances(spark, f):
    limits = [(1, "water", 0.03), (2, "gas", 0.02)]
    met = [G.closer_than(f.where("label = 0"), f.where(F.col("label") == label), m, [], ("vec_id", "vec_id")).withColumn("kind", F.lit(kind)) for label, kind, m in limits]
    return reduce(DataFrame.unionByName, met).select("a_id", "b_id", "kind", V.rounded(F.col("d"), 6).alias("d"))


@query(f"SELECT vec_id, round(list_min(list_transform(range(0, 32), lambda k: e[(3 * k) % 64 + 1])), 6) AS z FROM ({_E}) WHERE list_min(list_transform(range(0, 32), lambda k: e[(3 * k) % 64 + 1])) < -0.25")
def ground_height(spark, d):
    f = _features(spark, d).withColumn("z", geo.min_z(F.col("coords")))
    return f.where("z < -0.25").select("vec_id", F.round("z", 6).alias("z"))


_Z = "list_min(list_transform(range(0, 32), lambda k: {{'d': power({0}[2*k+1] - x, 2) + power({0}[2*k+2] - y, 2), 'z': {0}[(3*k)%64+1]}})).z"


@query(f"""WITH f AS ({_E}), s AS (SELECT vec_id, label, e, e[k] AS x1, e[k+1] AS y1, e[k+2] AS x2, e[k+3] AS y2 FROM f, (SELECT range AS k FROM range(1, 62, 2))), c AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.e AS ae, b.e AS be, a.x1, a.y1, a.x2, a.y2, (a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1) AS d, (b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1) AS t, (b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1) AS u FROM s a JOIN s b ON a.label = 0 AND b.label = 1),
p AS (SELECT a_id, b_id, ae, be, x1 + t / d * (x2 - x1) AS x, y1 + t / d * (y2 - y1) AS y FROM c WHERE d <> 0 AND t / d > 0 AND t / d < 1 AND u / d > 0 AND u / d < 1)
SELECT a_id, b_id, round(min(abs({_Z.format("ae")} - {_Z.format("be")})), 6) AS gap FROM p GROUP BY 1, 2""")
def power_gap(spark, d):
    return _gaps(_features(spark, d))


def _gaps(f):
    return G.height_gaps(f.where("label = 0"), f.where("label = 1"), 0.2, [], ("vec_id", "vec_id")).select("a_id", "b_id", V.rounded(F.col("gap"), 6).alias("gap"))


@query(f"SELECT vec_id FROM ({_E}) WHERE {_LEN} > 5.5")
def grounding(spark, d):
    return A.over_limit(_features(spark, d), geo.line_length(F.col("coords")), F.lit(5.5)).select("vec_id")


# Bill of materials


def _objects(spark, d):
    """Orders as projects: their line items are cables, boxes and poles."""
    li, p = _t(spark, d, "lineitem", "part")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "cable").when(F.col("l_linenumber") % 3 == 1, "boite").otherwise("ptech")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("project_id"), kind.alias("obj_type"), F.col("l_quantity").alias("length"), F.lit("").alias("extremity"), F.when(F.col("p_size") > 25, "9").otherwise("7").alias("height"),
        F.lit("").alias("kind"), (F.col("p_size") * 2).alias("capacity"), F.when(F.col("l_returnflag") == "R", "OUI").otherwise("").alias("reuse"),
    )


_OBJ = "(SELECT l_orderkey AS project_id, CASE l_linenumber % 3 WHEN 0 THEN 'cable' WHEN 1 THEN 'boite' ELSE 'ptech' END AS t, l_quantity AS len, CASE WHEN p_size > 25 THEN '9' ELSE '7' END AS h, p_size * 2 AS cap, l_returnflag = 'R' AS reused FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH o AS {_OBJ}, c AS (SELECT project_id, coalesce(sum(len) FILTER (t = 'cable'), 0) AS km, count(*) FILTER (t = 'cable') AS n, count(*) FILTER (t = 'boite' AND cap >= 72) AS fdt, count(*) FILTER (t = 'boite' AND cap < 72) AS fat, count(*) FILTER (t = 'ptech') AS poles FROM o GROUP BY 1),
l AS (SELECT project_id, m AS material, 1.0 AS net, 1.0 AS final FROM c, (VALUES ('safety'),('mobilisation'),('project management'),('warehouse'),('survey'),('as-built')) v(m)
UNION ALL SELECT project_id, '500002050', km, ceil(round(km + km * 0.05 + (poles * 7.5 + (fdt + fat + 1) * 2.0 + km * 10 / 1000) / 1000, 9) / 2) * 2 FROM c WHERE km > 0 UNION ALL SELECT project_id, '200001033', km * 1000, ceil(round(km * 1000 + km * 1000 * 0.03, 9) / 500) * 500 FROM c WHERE km > 0
UNION ALL SELECT project_id, 'splicing', (fdt + fat) * 4, (fdt + fat) * 4 FROM c WHERE fdt + fat > 0 UNION ALL SELECT project_id, 'cable label', n, n FROM c WHERE n > 0 UNION ALL SELECT project_id, 'FDT label', fdt, fdt FROM c WHERE fdt > 0 UNION ALL SELECT project_id, 'FAT label', fat, fat FROM c WHERE fat > 0
UNION ALL SELECT project_id, 'pole label', poles, poles FROM c WHERE poles > 0 UNION ALL SELECT project_id, 'hanger', n, n FROM c WHERE km > 0 UNION ALL SELECT project_id, 'test', fdt + fat, fdt + fat FROM c WHERE fdt + fat > 0 UNION ALL SELECT project_id, 'permit', km * 1000, km * 1000 FROM c WHERE km > 0
UNION ALL SELECT project_id, CASE WHEN h = '9' THEN 'pole 9 m 4 in' ELSE 'pole 7 m 4 in' END, count(*) FILTER (NOT reused), count(*) FILTER (NOT reused) FROM o WHERE t = 'ptech' GROUP BY 1, 2 UNION ALL SELECT project_id, CASE WHEN cap >= 72 THEN '500002054' ELSE '500002142' END, count(*) FILTER (NOT reused), count(*) FILTER (NOT reused) FROM o WHERE t = 'boite' GROUP BY 1, 2)
SELECT project_id, material, round(net::DOUBLE, 4) AS net, round(final::DOUBLE, 4) AS final FROM l""")
def bom_lines(spark, d):
    return B.build_bom(_objects(spark, d)).select("project_id", "material", F.round("net", 4).alias("net"), F.round("final", 4).alias("final"))


@query("""SELECT o_orderkey, round(n * 0.05, 4) AS loss, round((s * 15 + n * 10 / 1000) / 1000, 5) AS reserve, ceil(round(n + n * 0.05 + (s * 15 + n * 10 / 1000) / 1000, 9) / 2) * 2 AS final FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS n, o_orderkey % 5 AS s FROM orders)""")
def bom_quantity(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.lit("500002050").alias("material"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("net"), F.lit("KM").alias("unit"), (F.col("o_orderkey") % 5).alias("splice"), F.lit(10).alias("bend"))
    return B.quantities(rows).select("o_orderkey", F.round("loss", 4).alias("loss"), F.round("reserve", 5).alias("reserve"), "final")


@query(f"""SELECT project_id, CASE WHEN cap >= 72 THEN '500002054' ELSE '500002142' END AS material, count(*) AS total, count(*) FILTER (reused) AS reused, count(*) FILTER (NOT reused) AS quantity, CASE WHEN count(*) FILTER (reused) > 0 THEN 'confirm' ELSE 'matched' END AS status FROM {_OBJ} WHERE t = 'boite' GROUP BY 1, 2""")
def reuse_deduction(spark, d):
    return B.reuse_deduction(_objects(spark, d).where("obj_type = 'boite'"), ["project_id"], B.box_material(F.col("capacity"), F.col("kind")), F.col("reuse"))


@query("""SELECT p_partkey, c::INTEGER AS core, ((c - 1) // per + 1)::INTEGER AS tube, ((c - 1) % per + 1)::INTEGER AS fiber FROM (SELECT p_partkey, unnest(range(1, p_size % 12 + 1)) AS c, coalesce(greatest(24 // nullif(p_partkey % 7, 0), 1), 4) AS per FROM part)""")
def fiber_alloc(spark, d):
    return B.fiber_cores(_t(spark, d, "part"), F.col("p_size") % 12, F.lit(24), F.col("p_partkey") % 7, ["p_partkey"])


@query("SELECT min(event_id) AS event_id, user_id, event_type, props FROM events GROUP BY user_id, event_type, props")
def dedupe_submissions(spark, d):
    return dedupe_batch(_t(spark, d, "events"), "event_id", ["user_id", "event_type", "props"]).select("event_id", "user_id", "event_type", "props")


#: Other names of queries that once took part of each line or text under the shorter name.
for _name in ("fill_down", "coverage", "line_crossing", "min_distance", "utility_clearance", "power_gap", "grounding"):
    QUERIES[f"{_name}_whole"], ORACLE[f"{_name}_whole"] = QUERIES[_name], ORACLE[_name]
