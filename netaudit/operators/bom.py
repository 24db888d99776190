"""Bill of materials and fibre allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit import config
from netaudit.functions.values import normalize_reuse


def _of(material: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), material)


def loss(net: Column, material: Column) -> Column:
    return net * F.coalesce(_of(material, config.LOSS), F.lit(0.0))


def reserve_m(net: Column, pcp: Column, splice: Column, manhole: Column, pole: Column, endpoint: Column, bend: Column, strict_units: bool = False) -> Column:
    """Metres kept in reserve. Bend growth is per mille of the net length, which is in kilometres: it counts as it stands, or as metres with strict_units."""
    r = config.RESERVE
    return pcp * r["pcp"] + splice * r["splice"] * 2 + manhole * r["manhole"] + pole * r["pole"] + endpoint * r["endpoint"] + net * bend / 1000.0 * (1000.0 if strict_units else 1.0)


def packaged(quantity: Column, material: Column) -> Column:
    pack = _of(material, config.PACK)
    return F.when(material.isin(*config.EXACT), quantity).when(pack > 0, F.ceil(quantity / pack) * pack).otherwise(F.ceil(quantity)).cast("double")


def quantities(rows: DataFrame, material: str = "material", net: str = "net", unit: str = "unit", strict_units: bool = False) -> DataFrame:
    """rows(material, net, unit, pcp, splice, manhole, pole, endpoint, bend) with loss, reserve, before and final, rounded to 6."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    res = reserve_m(F.col(net), *map(zero, ("pcp", "splice", "manhole", "pole", "endpoint", "bend")), strict_units)
    out = rows.withColumn("loss", loss(F.col(net), F.col(material))).withColumn("reserve", res / F.when(F.col(unit) == "KM", 1000.0).otherwise(1.0))
    out = out.withColumn("before", F.col(net) + F.col("loss") + F.col("reserve")).withColumn("final", packaged(F.round("before", 9), F.col(material)))
    return out.withColumns({c: F.round(c, 6) for c in ("loss", "reserve", "before", "final")})


def pole_material(height: Column, kind: Column) -> Column:
    return F.when(height.contains("9"), "pole 9 m 4 in").when(kind.contains("3"), "pole 7 m 3 in").when(kind.contains("2.5"), "pole 7 m 2.5 in").otherwise("pole 7 m 4 in")


def box_material(capacity: Column, kind: Column) -> Column:
    t = F.upper(F.coalesce(kind, F.lit("")))
    return F.when((capacity >= 72) | t.contains("FDT") | t.contains("72"), config.MATERIALS["fdt"][0]).otherwise(config.MATERIALS["box16"][0])


def reuse_deduction(objects: DataFrame, keys: list[str], material: Column, reuse: Column) -> DataFrame:
    """(keys…, material, total, reused, quantity, status): new pieces are the total less the reused; any reuse asks for confirmation."""
    g = objects.groupBy(*keys, material.alias("material")).agg(F.count("*").alias("total"), F.count_if(normalize_reuse(reuse) == "yes").alias("reused"))
    return g.withColumn("quantity", F.greatest(F.col("total") - F.col("reused"), F.lit(0))).withColumn("status", F.when(F.col("reused") > 0, "confirm").otherwise("matched"))


#: Fixed lines of every project.
FIXED_LINES = ("safety", "mobilisation", "project management", "warehouse", "survey", "as-built")


def build_bom(objects: DataFrame, strict_units: bool = False) -> DataFrame:
    """objects(project_id, obj_type, length, extremity, height, kind, capacity, reuse) → lines (project_id, line, material, unit, net, loss, reserve, final, status).
    Counts of a project come from one aggregation; lines are made from the counts."""
    kind = F.col("obj_type")
    cable, box, pole = kind == "cable", kind == "boite", kind == "ptech"
    is_fdt = box_material(F.col("capacity"), F.col("kind")) == config.MATERIALS["fdt"][0]
    c = objects.groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(cable, F.col("length"))), F.lit(0.0)).alias("km"), F.count_if(cable).alias("cables"), F.count_if(cable & (F.trim("extremity") != "")).alias("splices"),
        F.count_if(box & is_fdt).alias("fdt"), F.count_if(box & ~is_fdt).alias("fat"), F.count_if(pole).alias("poles"),
    )
    pcp = F.col("fdt") + F.col("fat")
    line = lambda n, m, unit, q, when, status="matched": F.when(when, F.struct(F.lit(n).alias("seq"), F.lit(m).alias("material"), F.lit(unit).alias("unit"), q.cast("double").alias("net"), F.lit(status).alias("status")))
    some, any_box = F.col("km") > 0, pcp > 0
    lines = [line(k, m, "PC", F.lit(1.0), F.lit(True)) for k, m in enumerate(FIXED_LINES)] + [
        line(10, config.MATERIALS["cable"][0], "KM", F.col("km"), some), line(11, config.MATERIALS["steel_wire"][0], "M", F.col("km") * 1000, some),
        line(40, "splicing", "PC", pcp * config.CORES_PER_PCP, any_box, "confirm"), line(41, "cable label", "PC", F.col("cables"), F.col("cables") > 0), line(42, "FDT label", "PC", F.col("fdt"), F.col("fdt") > 0),
        line(43, "FAT label", "PC", F.col("fat"), F.col("fat") > 0), line(44, "pole label", "PC", F.col("poles"), F.col("poles") > 0), line(45, "hanger", "PC", F.col("cables"), some, "confirm"),
        line(46, "test", "PC", pcp, any_box, "confirm"), line(47, "permit", "M", F.col("km") * 1000, some, "confirm"),
    ]
    made = c.select("*", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("l")).select("project_id", "l.*", F.when(F.col("l.seq") == 10, F.col("splices")).alias("splice"), F.when(F.col("l.seq") == 10, F.col("poles")).alias("pole"), F.when(F.col("l.seq") == 10, pcp + 1).alias("endpoint"), F.when(F.col("l.seq") == 10, config.BEND_PERMILLE).alias("bend"))
    measured = quantities(made.where("seq IN (10, 11)"), strict_units=strict_units).select("project_id", "seq", "material", "unit", "net", "loss", "reserve", "final", "status")
    pieces = made.where("seq NOT IN (10, 11)").select("project_id", "seq", "material", "unit", "net", F.lit(0.0).alias("loss"), F.lit(0.0).alias("reserve"), F.col("net").alias("final"), "status")
    new = [reuse_deduction(objects.where(t), ["project_id"], m, F.col("reuse")).select("project_id", F.lit(s).alias("seq"), "material", F.lit("PC").alias("unit"), F.col("quantity").cast("double").alias("net"), F.lit(0.0).alias("loss"), F.lit(0.0).alias("reserve"), F.col("quantity").cast("double").alias("final"), "status") for t, s, m in ((pole, 20, pole_material(F.coalesce("height", F.lit("")), F.coalesce("kind", F.lit("")))), (box, 30, box_material(F.col("capacity"), F.col("kind"))))]
    every = measured.unionByName(pieces).unionByName(new[0]).unionByName(new[1])
    return every.withColumn("line", F.row_number().over(Window.partitionBy("project_id").orderBy("seq", "material"))).drop("seq")


def fiber_cores(cables: DataFrame, used: Column, capacity: Column, modulo: Column, keys: list[str]) -> DataFrame:
    """(keys…, core, tube, fiber): one row for each used core; a tube has capacity ÷ modulo cores, at least one, or 4 if either is unknown."""
    per = F.coalesce(F.greatest(F.floor(capacity / F.nullif(modulo, F.lit(0))), F.lit(1)), F.lit(4)).cast("int")
    rows = cables.select(*keys, used.cast("int").alias("_u"), per.alias("_p")).where("_u > 0")
    each = rows.select(*keys, "_p", F.explode(F.sequence(F.lit(1), F.col("_u"))).alias("core"))
    return each.select(*keys, "core", (F.floor((F.col("core") - 1) / F.col("_p")) + 1).cast("int").alias("tube"), (F.pmod(F.col("core") - 1, F.col("_p")) + 1).alias("fiber"))
