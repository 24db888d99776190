"""From sheets to features, rules, specifications and the judgements of a whole case. Sheets are rows (project_id, file, sheet, row_no, cells)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit import config
from netaudit.functions import values as V
from netaudit.operators.cut import cut
from netaudit.operators.joins import join_heads, orphans, unpivot_ends
from netaudit.operators.lookup import bom_codes
from netaudit.operators.windows import fiber_core_repeats, fill_down, repeat_of_first

KEYS = ["project_id", "file", "sheet"]


def clean(cells: Column) -> Column:
    """Cells without line breaks and outer blanks; null as empty."""
    return F.transform(cells, lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))


def column_at(header: Column, *names: str) -> Column:
    """Place, from 0, of the first header cell that is or begins with one of the names; null if there is none."""
    hit = lambda h: reduce(lambda a, b: a | b, [F.trim(h).startswith(n) for n in names])
    return F.nullif(F.array_position(F.transform(header, lambda h: F.coalesce(hit(h), F.lit(False))), F.lit(True)), F.lit(0)).cast("int") - 1


def cell(cells: Column, at: Column) -> Column:
    """The trimmed cell at a place; null if it is blank, or there is no such place."""
    return F.nullif(F.trim(F.get(cells, at)), F.lit(""))


def normalize_headers(cells: Column, layer: Column) -> Column:
    """Official fields of header cells: upper case, aliases resolved; blank cells are empty."""
    alias = F.create_map(*[F.lit(x) for kv in config.HEADER_ALIASES.items() for x in kv])
    name = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.transform(cells, lambda c: F.when((layer == "CABLE") & (name(c) == "类型"), "TYPE_CABLE").otherwise(F.coalesce(F.try_element_at(alias, name(c)), name(c))))


def sheets_to_features(sheets: DataFrame) -> DataFrame:
    """Features (project_id, layer, source_layer, feature_id, feature_seq, props) of the sheets that are official layers or the bill. The header is the first
    filled row of the first five; blank rows are left out, blank cells are empty, of equal headers the last one holds. feature_seq follows file, sheet and
    row within a layer; it comes from one number a sheet, so no window runs over a layer's rows."""
    layer = F.coalesce(V.sheet_layer(F.col("sheet")), F.when(F.upper(F.trim("sheet")) == config.BOM_SHEET.upper(), F.trim("sheet")))
    filled = lambda df: df.where(F.exists("cells", lambda c: F.trim(c) != ""))
    top = cut(filled(sheets.where("row_no <= 5")).select(*KEYS, "row_no", "cells"))
    # the layer is told once a name, not once a row
    named = cut(cut(top.select("sheet").distinct()).withColumn("layer", layer).where("layer IS NOT NULL"))
    rows = join_heads(filled(sheets), named, ["sheet"])
    head = cut(top.join(named, "sheet").groupBy(*KEYS, "layer").agg(F.min(F.struct("row_no", "cells")).alias("h")).select(*KEYS, "layer", F.col("h.row_no").alias("head_row"), normalize_headers(F.col("h.cells"), F.col("layer")).alias("names")))
    # only of layers of several sheets are the rows counted
    several = cut(head.groupBy("project_id", "layer").agg(F.count("*").alias("n")).where("n > 1").select("project_id", "layer"))
    if several.isEmpty():
        ends = head.select(*KEYS, F.lit(0).alias("before"))
    else:
        rows_of = rows.groupBy(*KEYS, "layer").agg(F.max("row_no").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy("project_id", "layer").orderBy("file", "sheet").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = rows_of.select(*KEYS, before.alias("before"))
    # once a sheet: each named column with the place of the next one of that name, so a row needs no search
    again = lambda n, i: F.array_position(F.slice("names", i + 2, F.size("names")), n)
    fields = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("key"), i.alias("at"), F.when(again(n, i) > 0, i + again(n, i)).alias("next"))), lambda f: f["key"] != "")
    heads = cut(head.join(ends, KEYS).select(*KEYS, "head_row", "before", fields.alias("fields")))
    body = join_heads(rows, heads, KEYS).where("row_no > head_row")
    last = F.filter("fields", lambda f: (f["at"] < F.size("cells")) & (f["next"].isNull() | (f["next"] >= F.size("cells"))))
    value = lambda v: F.when(F.trim(v) == "", "").otherwise(F.coalesce(v, F.lit("")))
    props = F.map_from_entries(F.transform(last, lambda f: F.struct(f["key"].alias("key"), value(F.get("cells", f["at"])).alias("value"))))
    nth = F.col("row_no") - F.col("head_row")
    return body.select("project_id", "layer", F.col("sheet").alias("source_layer"), F.concat_ws("-", F.lit("EXCEL"), "layer", nth.cast("string")).alias("feature_id"), (F.col("before") + nth).cast("bigint").alias("feature_seq"), props.alias("props"))


def parse_validation_rules(sheets: DataFrame) -> DataFrame:
    """(KEYS…, row_no, no, sub_no, check_item, check_content, layers, fields, rule, remark) of rule sheets. Numbers are carried down over merged cells; blank rows, header
    rows and rows without item, content and rule are left out. Layers are parted by blanks, fields by commas."""
    names = ("no", "sub_no", "check_item", "check_content", "layer_text", "field_text", "rule", "remark")
    rows = sheets.select(*KEYS, "row_no", clean(F.col("cells")).alias("c")).where(F.exists("c", lambda c: c != ""))
    rows = rows.select(*KEYS, "row_no", *[F.coalesce(F.get("c", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])
    head = (F.col("no") == "NO.") | (F.col("check_item") == "检测项")
    rows = fill_down(rows.withColumn("_head", head), ["no", "sub_no"], KEYS, ["row_no"]).where("NOT _head AND (check_item <> '' OR check_content <> '' OR rule <> '')")
    parts = lambda name, by: F.filter(F.transform(F.split(name, by), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(*KEYS, "row_no", F.coalesce("no", F.lit("")).alias("no"), F.coalesce("sub_no", F.lit("")).alias("sub_no"), "check_item", "check_content", parts("layer_text", r"\s+").alias("layers"), parts("field_text", ",").alias("fields"), "rule", "remark")


#: Columns of a specification and the words that their headers hold, the first that is found.
SPEC_COLUMNS = {
    "name": (("nom champ",),), "desc_cn": (("中文描述",), ("字段描述",)), "desc_fr": (("descriptif",),), "example": (("exemple",),), "type": (("type", "champ"),), "length": (("longueur",),),
    "format": (("format",),), "required": (("obligatoire",),), "condition_desc": (("condition",),), "constraint": (("contrainte",),),
}


def parse_field_specs(sheets: DataFrame) -> DataFrame:
    """(KEYS…, row_no, the ten columns, max_length) of specification sheets: the header is the first row whose first cell holds "nom champ"; rows without a name
    are left out, columns without a header are empty."""
    rows = sheets.where(~F.col("sheet").isin(*config.RULE_SHEETS)).select(*KEYS, "row_no", clean(F.col("cells")).alias("c"))
    head = rows.where(F.lower(F.get("c", F.lit(0))).contains("nom champ")).groupBy(*KEYS).agg(F.min(F.struct("row_no", "c")).alias("h"))
    has = lambda h, words: reduce(lambda a, b: a & b, [F.contains(h, F.lit(w)) for w in words])
    place = lambda words: F.nullif(F.array_position(F.transform("head", lambda h: has(F.lower(h), words)), F.lit(True)), F.lit(0)).cast("int") - 1
    head = head.select(*KEYS, F.col("h.row_no").alias("head_row"), F.col("h.c").alias("head")).select(*KEYS, "head_row", *[F.coalesce(*map(place, ways)).alias(f"_{n}") for n, ways in SPEC_COLUMNS.items()])
    found = rows.join(head, KEYS).where("row_no > head_row").select(*KEYS, "row_no", *[F.coalesce(F.get("c", F.col(f"_{n}")), F.lit("")).alias(n) for n in SPEC_COLUMNS]).where("name <> ''")
    return found.withColumn("max_length", max_length_for(F.col("name"), spec_length(F.col("length"))))


def spec_length(length: Column) -> Column:
    """The first integer of a length's text, as 30 of max 30."""
    return V.first_digits(length).cast("int")


def max_length_for(field: Column, fallback: Column) -> Column:
    """The overriding length of a field, by its full name or its first ten characters, else the fallback."""
    short = {k[:10].upper(): n for k, n in config.LENGTH_OVERRIDES.items()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in short.items() for x in kv]), F.upper(F.substring(field, 1, 10))), fallback)


def serializable(rows: DataFrame) -> DataFrame:
    """Columns as they can be written to JSON: texts, numbers and booleans stay, timestamps and dates are ISO texts, others are texts."""
    plain = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    form = lambda c, t: F.col(c) if t in plain else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if t.startswith("timestamp") else F.col(c).cast("string")
    return rows.select(*[form(f"`{c}`", t).alias(c) for c, t in rows.dtypes])


def complete_truncated_fields(props: Column) -> Column:
    """Props with the full name beside each name that was cut to ten characters, unless it is there."""
    ways: dict[str, list[str]] = {}
    for short, full in config.TRUNCATED.items():
        ways.setdefault(full, []).append(short)
    twins = F.create_map(*[x for full, shorts in ways.items() for x in (F.lit(full), F.coalesce(*[F.try_element_at(props, F.lit(s)) for s in shorts]))])
    return F.map_concat(props, F.map_filter(twins, lambda k, v: v.isNotNull() & ~F.map_contains_key(props, k)))


def match_layer(rows: DataFrame, key: str, mode: str = "contains", first: bool = True, order: str = "layer_order") -> DataFrame:
    """Rows of the layers that contain the key, begin with it (prefix), or are it or its alias (exact), in any case; of several, the first a project in layer order."""
    u, k = F.upper("layer"), key.upper()
    names = [k, *[a for a, n in config.LAYER_ALIASES.items() if n == k], *([config.LAYER_ALIASES[k]] if k in config.LAYER_ALIASES else [])]
    found = rows.where({"contains": u.contains(k), "prefix": u.startswith(k), "exact": F.trim(u).isin(*names)}[mode])
    if not first:
        return found
    best = found.groupBy("project_id").agg(F.min(F.struct(order, "layer")).alias("_best")).select("project_id", F.col("_best.layer").alias("layer"))
    return found.join(best, ["project_id", "layer"], "left_semi")


def engineering_objects(features: DataFrame) -> DataFrame:
    """(project_id, object_type, id, code, longueur, capacite, type, nb_fibre_util, hauteur_appui, reuse) of the first layer of each of the five types, as texts:
    the first filled source field, numbers in shortest form, reuse as yes or no; null where there is none. The id is type:code."""
    filled = lambda f: F.when(F.trim(F.col("props")[f]) != "", F.col("props")[f])
    parts = []
    for kind, fields in config.ENGINEERING_OBJECTS.items():
        value = {n: F.coalesce(*map(filled, source)) if source else F.lit(None).cast("string") for n, source in fields.items()}
        for n in config.NUMERIC_FIELDS:
            d = value[n].try_cast("double")
            value[n] = F.when(d.isNull(), value[n]).when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(d.cast("string"))
        value["reuse"] = F.when(value["reuse"].isNotNull(), V.normalize_reuse(value["reuse"]))
        parts.append(match_layer(features, kind, "prefix").select("project_id", F.lit(kind).alias("object_type"), F.concat(F.lit(f"{kind}:"), F.coalesce(value["code"], F.lit(""))).alias("id"), *[v.alias(n) for n, v in value.items()]))
    return reduce(DataFrame.unionByName, parts)


def to_entity(features: DataFrame, layer: str, fields: dict[str, tuple[str, str]], fallback: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, feature_id, source_layer, coords if there are any, fields…) of the layer a project has for an entity: the one of that name, else one that contains
    it, else one of the fallback. fields are {name: (source, kind)}; null tokens are null, values that are not of the kind too."""
    u = F.upper("layer")
    rank = F.when(u == layer.upper(), 0).when(u.contains(layer.upper()), 1)
    rank = rank.when(u.isin(*[n.upper() for n in fallback]), 2) if fallback else rank
    ranked = features.withColumn("_rank", rank).where("_rank IS NOT NULL")
    best = ranked.groupBy("project_id").agg(F.min("_rank").alias("_rank"))

    def value(source: str, kind: str) -> Column:
        text = V.null_if_token(F.trim(V.get_ci(F.col("props"), source)))
        return text if kind == "string" else V.number(text) if kind == "double" else V.number(text).try_cast(kind) if kind in ("int", "bigint") else text.try_cast(kind)

    return ranked.join(best, ["project_id", "_rank"], "left_semi").select("project_id", "feature_id", F.col("layer").alias("source_layer"), *[c for c in ("coords",) if c in features.columns], *[value(*f).alias(n) for n, f in fields.items()])


def parseable(manifest: DataFrame, sheets: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, parseable) of each package of a manifest (key, suffix): whether it holds a file of a GIS, an official sheet or a bill."""
    sheet = F.coalesce(V.sheet_layer(F.col("sheet")).isNotNull() | F.col("sheet").rlike("(?i)BOM|物料"), F.lit(False))
    flags = manifest.select(key, F.lower("suffix").isin(*config.GIS_SUFFIXES).alias("ok")).unionByName(sheets.select(key, sheet.alias("ok")))
    return flags.groupBy(key).agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("parseable"))


def files_of(manifest: DataFrame, what: str) -> DataFrame:
    """Files of a manifest (path, name, suffix, …) that hold rules, procedures, bill or core sheets (bom, fiber) or a geopackage (gpkg), by suffix and words of the name."""
    sheet = F.lower("suffix").isin(*config.SHEET_SUFFIXES)
    word = lambda words: reduce(lambda a, b: a | b, [F.col("name").contains(w) for w in words])
    tests = {"rules": sheet & word(config.RULE_FILES), "procedures": sheet & word(config.PROCEDURE_FILES), "gpkg": F.lower("suffix") == "gpkg"}
    return manifest.where(tests[what] if what in tests else sheet & (V.classify_table(F.col("name")) == what))


def missing_sidecars(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, base, missing) of each base name that has a .shp but not all of its companions."""
    base = F.lower(F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1))
    held = manifest.groupBy(*keys, base.alias("base")).agg(F.collect_set(F.lower("suffix")).alias("held")).where(F.array_contains("held", "shp"))
    return held.select(*keys, "base", F.array_except(F.array(*map(F.lit, config.REQUIRED_SUFFIXES)), "held").alias("missing")).where(F.size("missing") > 0)


def pipeline_summary(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """(project_id, n_layers, n_objects, n_cables, missing): layers and objects of each project, objects of layers with CABLE in their name, and companions that its files lack."""
    counts = features.groupBy("project_id", "layer").agg(F.count("*").alias("n")).groupBy("project_id").agg(F.count("*").alias("n_layers"), F.sum("n").alias("n_objects"), F.coalesce(F.sum(F.when(F.upper("layer").contains("CABLE"), F.col("n"))), F.lit(0)).alias("n_cables"))
    lacks = missing_sidecars(manifest, ["project_id"]).groupBy("project_id").agg(F.sum(F.size("missing")).alias("missing"))
    return counts.join(lacks, "project_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def count_cables(features: DataFrame) -> DataFrame:
    return features.groupBy("project_id").agg(F.count_if(F.upper("layer").contains("CABLE")).alias("n_cables"))


def merge_params(base: DataFrame, override: DataFrame) -> DataFrame:
    """(section, key, value): parameters of the base, overridden where the other side has a value; keys of either side."""
    o = override.withColumnRenamed("value", "_value")
    return base.join(o, ["section", "key"], "full").select("section", "key", F.coalesce("_value", "value").alias("value"))


def with_suggestion(issues: DataFrame) -> DataFrame:
    """Issues with blocking_reason and fix_suggestion, by the rule's group."""
    rule, what, why = F.col("rule_id"), F.coalesce("object_id", F.lit("?")), F.coalesce("message", F.lit("?"))
    fix = (
        F.when(rule.isin("R005", "R005_4"), F.format_string("check that CODE, ORIGINE and EXTREMITE of %s agree with the device layers: %s", what, why))
        .when(rule.isin("R010", "R024"), F.format_string("check that the geometry of %s lies on its devices: %s", what, why))
        .when(rule.isin("R019", "R020", "R030"), F.format_string("check the capacity or the references of %s: %s", what, why))
        .when(rule.isin("R001", "R002", "R003", "R004"), F.format_string("check that the files are complete and the layers named by the rules: %s", why))
        .otherwise(F.format_string("mend %s: %s", what, why))
    )
    return issues.withColumn("blocking_reason", F.format_string("rule %s: %s - %s", rule, what, why)).withColumn("fix_suggestion", fix)


def _case_heads(sheets: DataFrame) -> DataFrame:
    """The first row of each sheet, written, so it is looked for once."""
    return cut(sheets.where("row_no = 1").select(*[k for k in KEYS if k in sheets.columns], "cells"))


def _case_rows(sheets: DataFrame, sheet: Column, columns: dict[str, tuple[str, ...]], heads: DataFrame | None = None) -> DataFrame:
    """(project_id, sheet, row_no, named cells…) below the header, which is row 1 of each sheet (`heads`, if they are at hand)."""
    rows, keys = sheets.where(sheet), [k for k in KEYS if k in sheets.columns]
    heads = _case_heads(rows) if heads is None else heads.where(sheet)
    head = heads.select(*keys, *[column_at(F.col("cells"), *names).alias(f"_{n}") for n, names in columns.items()])
    return join_heads(rows.where("row_no > 1"), head, keys).select("project_id", "sheet", "row_no", *[cell(F.col("cells"), F.col(f"_{n}")).alias(n) for n in columns])


def case_code_empty(sheets: DataFrame) -> DataFrame:
    """Rows of the official sheets without a code."""
    return _case_rows(sheets, F.col("sheet").isin(*config.LAYERS), {"code": ("CODE",)}).where("code IS NULL")


def baseline_codes(sheets: DataFrame) -> DataFrame:
    """Distinct material codes of the bill of a good case."""
    return _case_rows(sheets, F.col("sheet") == config.BOM_SHEET, {"code": ("Material Code", "物料编码")}).select("code").dropna().distinct()


def material_library(official: DataFrame) -> DataFrame:
    """Distinct codes of the official bill sheets; the built-in codes if these hold none."""
    codes = bom_codes(official).select("code").distinct()
    built_in = official.sparkSession.createDataFrame([(c,) for c in config.MATERIAL_CODES], "code string")
    return codes.unionByName(built_in.join(codes.limit(1).select(F.lit(1).alias("_any")), F.col("_any") == 1, "left_anti"))


def construction_join(bill: DataFrame, materials: DataFrame, code: str = "code") -> DataFrame:
    """Lines of a bill with procedure, location, name and unit of their material (code, procedure, location, name, unit); null where it is not known."""
    return bill.join(materials.select(code, "procedure", "location", "name", "unit"), code, "left")


def check_case(sheets: DataFrame, known: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """(project_id, rule_id, object, message): the eight judgements of a case, of all projects at once; a project of `projects` without any sheet lacks them all.
    known holds material codes; without any, the bill is not judged."""
    issue = lambda df, rule, what, why: df.select("project_id", F.lit(rule).alias("rule_id"), what.alias("object"), why.alias("message"))
    every = sheets.select("project_id", "sheet") if projects is None else sheets.select("project_id", "sheet").unionByName(projects.select("project_id", F.lit(None).cast("string").alias("sheet")))
    present = cut(every.distinct()).groupBy("project_id").agg(F.collect_set("sheet").alias("held"))
    absent = present.select("project_id", F.explode(F.array_except(F.array(*map(F.lit, config.EXPECTED_SHEETS)), "held")).alias("sheet"))
    out = [issue(absent, "R-FILE-001", F.col("sheet"), F.concat(F.lit("sheet is missing: "), "sheet"))]

    heads = _case_heads(sheets)
    coded = _case_rows(sheets, F.col("sheet").isin(*config.LAYERS), {"code": ("CODE",)}, heads)
    out.append(issue(coded.where("code IS NULL"), "R-FLD-001", F.format_string("%s R%d", "sheet", F.col("row_no") - 1), F.format_string("no code in row %d", "row_no")))
    twice = repeat_of_first(coded.dropna(subset=["code"]), ["project_id", "sheet", "code"], "row_no")
    out.append(issue(twice, "R-FLD-002", F.format_string("%s CODE=%s", "sheet", "code"), F.format_string("code of row %d stands in row %d already", "row_no", "first_row")))

    cables = _case_rows(sheets, F.col("sheet") == "CABLE", {"code": ("CODE",), "start": ("起点", "ORIGINE"), "end": ("终点", "EXTREMITE")}, heads)
    ends = unpivot_ends(cables, {"start": F.col("start"), "end": F.col("end")}, ["project_id", "code"])
    devices = coded.where(F.col("sheet").isin(*config.CASE_DEVICES)).dropna(subset=["code"])
    dangling = orphans(ends, ["project_id", "ref"], devices, ["project_id", "code"], V.is_root_code(F.col("ref")))
    out.append(issue(dangling, "R-REL-004", F.concat_ws(" ", F.lit("CABLE"), "code"), F.format_string("%s refers to %s, which is no device", "side", "ref")))
    boxes = coded.where("sheet = 'BOITE'").join(present.where(F.array_contains("held", "CABLE")), "project_id", "left_semi")
    lonely = orphans(boxes, ["project_id", "code"], ends, ["project_id", "ref"])
    out.append(issue(lonely, "R-REL-001", F.concat(F.lit("BOITE "), "code"), F.lit("no cable refers to it")))

    cores = _case_rows(sheets, F.col("sheet") == config.FIBER_SHEET, {"node": ("所属节点",), "tray": ("托盘编号",), "splitter": ("光分路器",), "out": ("OUT",)}, heads).fillna("", ["node", "tray", "splitter", "out"])
    most = F.try_element_at(F.regexp_extract_all("splitter", F.lit("[0-9]+"), F.lit(0)), F.lit(-1)).try_cast("bigint")
    used = cores.groupBy("project_id", "node", "tray", "splitter").agg(F.count_distinct("out").alias("n")).withColumn("most", most).where("most > 0 AND n > most")
    out.append(issue(used, "R-DAT-001", F.concat_ws("/", "node", "tray", "splitter"), F.format_string("%d outputs of %d", "n", "most")))
    again = fiber_core_repeats(sheets)
    out.append(issue(again, "R-FIBER-001", F.format_string("%s R%d", "sheet", "row_no"), F.format_string("core %s stands in row %d already", "core", "first_row")))

    if known is not None:
        bill = _case_rows(sheets, F.col("sheet") == config.BOM_SHEET, {"code": ("Material Code", "物料编码")}, heads)
        strange = orphans(bill, ["code"], known, ["code"]).join(known.select("code").dropna().limit(1).select(F.lit(1).alias("_any")), F.col("_any") == 1, "left_semi")
        out.append(issue(strange, "R-BOM-001", F.concat(F.lit("BOM "), "code"), F.lit("no known material")))
    return reduce(DataFrame.unionByName, out)
