"""Readers of layers, tables, sheets and manifests, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.functions import geo
from netaudit.functions.values import classify_table, null_if_token
from netaudit.operators.cut import cut
from netaudit.operators.joins import join_heads
from netaudit.operators.ranks import numbered
from netaudit.operators.windows import detect_header


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def _ordered(rows: DataFrame, layer: Column, one_file: bool) -> DataFrame:
    """rows with _layer, _order (the layer's place by its first file's path) and _seq (the row's place in its layer, from 0 on), the same however files are split.

    A row's place in its block of a file, and prefix sums of the blocks' rows by path and start: one number a block. With one_file a layer is the
    first file, by path, of its name; others of that name in other folders are left out."""
    at = rows.select("*", layer.alias("_layer"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = at.groupBy("_layer", "_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    if one_file:
        blocks = blocks.join(blocks.groupBy("_layer").agg(F.min("_path").alias("_path")), ["_layer", "_path"])
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_layer").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    layers = blocks.groupBy("_layer").agg(F.min("_path").alias("_start")).select("_layer", (F.row_number().over(Window.orderBy("_start", "_layer")) - 1).alias("_order"))
    blocks = blocks.withColumn("_add", before - F.col("_first")).join(layers, "_layer").select("_path", "_block", "_add", "_order")
    return at.join(blocks, ["_path", "_block"]).withColumn("_seq", F.col("_at") + F.col("_add"))


_OWN = ("_layer", "_path", "_block", "_at", "_add", "_order", "_seq", "fid")


def _features(rows: DataFrame, project: str, wkt: str | None = None, crs: str | None = None) -> DataFrame:
    fields = [c for c in rows.columns if c not in (*_OWN, wkt)]
    texts = [x for f in fields for x in (F.lit(f), F.col(f"`{f}`").cast("string"))]
    kinds = dict(rows.dtypes)
    nothing = F.create_map().cast("map<string,string>")
    props = F.map_filter(F.create_map(*texts), lambda k, v: v.isNotNull()) if fields else nothing
    types = F.create_map(*[F.lit(x) for f in fields for x in (f, kinds[f])]) if fields else nothing
    shape = F.col(f"`{wkt}`") if wkt else F.lit(None).cast("string")
    return rows.select(
        F.lit(project).alias("project_id"), F.col("_layer").alias("layer"), F.col("_order").alias("layer_order"), F.col("_seq").cast("string").alias("feature_id"), F.col("_seq").alias("feature_seq"),
        geo.wkt_type(shape).alias("geom_type"), geo.parse_wkt(shape).alias("coords"), geo.parse_rings(shape).alias("rings"), F.lit(crs).cast("string").alias("crs"), props.alias("props"), types.alias("prop_types"), F.lit(False).alias("is_deleted"),
    )


def read_csv_layers(spark: SparkSession, paths: str | list[str], project: str = "p", wkt: str | None = None, crs: str | None = None) -> DataFrame:
    """Every CSV file is a layer named by its stem, the first by path of equal stems; `wkt` names the column of a geometry. Files of one call have one header;
    files of other columns go in calls of their own. Features are numbered in the files' order, layers in that of their paths."""
    return _features(_ordered(spark.read.option("header", True).csv(paths), _stem(), True), project, wkt, crs)


def read_json_layers(spark: SparkSession, paths: str | list[str], project: str = "p") -> DataFrame:
    """Each item of a JSON list, or a JSON object, is a feature of the layer named by the file's stem, the first by path of equal stems. Items that are no objects
    become {"value": item}. A file is one task's work, as such JSON can't be split."""
    files = spark.read.text(paths, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    rows = _ordered(files, _stem(), True).select("_layer", "_order", F.posexplode(items).alias("_nth", "_item"))
    item = F.try_parse_json("_item")
    is_object = F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))
    texts = F.when(is_object, F.from_json("_item", "map<string,string>")).otherwise(F.create_map(F.lit("value"), F.col("_item")))
    fields = F.variant_get(item, "$", "map<string,variant>")
    kind = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
    named = F.transform_values(fields, lambda k, v: F.coalesce(*[F.when(F.schema_of_variant(v).startswith(t), n) for t, n in kind.items()], F.when(F.schema_of_variant(v).startswith("DECIMAL"), "double"), F.lit("string")))
    kinds = F.when(is_object, named).otherwise(F.create_map(F.lit("value"), F.lit("string")))
    return rows.select(
        F.lit(project).alias("project_id"), F.col("_layer").alias("layer"), F.col("_order").alias("layer_order"), F.col("_nth").cast("string").alias("feature_id"), F.col("_nth").cast("long").alias("feature_seq"),
        F.lit(None).cast("string").alias("geom_type"), F.lit(None).cast(geo.COORDS).alias("coords"), F.lit(None).cast(f"array<{geo.COORDS}>").alias("rings"), F.lit(None).cast("string").alias("crs"),
        F.map_filter(texts, lambda k, v: v.isNotNull()).alias("props"), kinds.alias("prop_types"), F.lit(False).alias("is_deleted"),
    )


def read_table(spark: SparkSession, path: str, layer: str, project: str = "p", wkt: str | None = None, crs: str | None = None) -> DataFrame:
    """A Parquet table as a layer, with a geometry column in WKT if it has one, numbered in the order of its files and rows."""
    return _features(_ordered(spark.read.parquet(path), F.lit(layer), False), project, wkt, crs)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, suffix, size, modified) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def pick_source_file(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Of files of one name, the largest; of equals, the first by path."""
    w = Window.partitionBy(*keys, F.lower("name")).orderBy(F.desc("size"), "path")
    return manifest.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rank_projects(candidates: DataFrame, bonus: str, survey: str) -> DataFrame:
    """candidates(package, project, n_features, size, is_gpkg) in order of preference: words of the name add or take 100000 (0 at least), then features, then
    not being a survey, then size; a geopackage goes first if it has as many features as the best."""
    n = F.lower("project")
    score = F.greatest(F.col("n_features") + F.when(n.rlike(bonus), 100000).otherwise(0) - F.when(n.rlike(survey), 100000).otherwise(0), F.lit(0))
    w = Window.partitionBy("package")
    out = candidates.withColumn("score", score).withColumn("_best", F.max("n_features").over(w))
    order = [F.desc(F.col("is_gpkg") & (F.col("n_features") >= F.col("_best"))), F.desc("score"), F.asc(n.rlike(survey)), F.desc("size"), "project"]
    return out.withColumn("rank", F.row_number().over(w.orderBy(*order))).drop("_best")


def _below_header(sheets: DataFrame) -> DataFrame:
    """(project_id, file, sheet, row_no, cells, fields): rows below the detected header, with the names and places, from 0, of the header's columns; of equal names the first."""
    keys = ["project_id", "file", "sheet"]
    top = cut(sheets.where("row_no <= 10"))  # headers are looked for in these rows only
    head = detect_header(top, keys, "row_no", "cells")
    names = top.join(head, keys).where("row_no = header_row").select(*keys, "header_row", F.transform("cells", lambda c, i: F.when(F.trim(c) != "", F.concat(F.trim(c), F.lit(""))).otherwise(F.concat(F.lit("Col_"), (i + 1).cast("string")))).alias("names"))
    firsts = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("key"), i.alias("at"))), lambda f: F.array_position("names", f["key"]) == f["at"] + 1)
    rows = join_heads(sheets, cut(names.select(*keys, "header_row", firsts.alias("fields"))), keys).where("row_no > header_row")
    return rows.select(*keys, "row_no", "cells", "fields")


def _record() -> Column:
    held = F.filter("fields", lambda f: f["at"] < F.size("cells"))
    return F.map_from_entries(F.transform(held, lambda f: F.struct(f["key"].alias("key"), F.trim(F.get("cells", f["at"])).alias("value")))).alias("record")


def sheet_records(sheets: DataFrame) -> DataFrame:
    """(project_id, file, sheet, row_no, record): rows below the detected header as maps from header to trimmed cell; blank headers are Col_i."""
    return _below_header(sheets).select("project_id", "file", "sheet", "row_no", _record())


def workbook_summary(sheets: DataFrame, samples: int = 3) -> DataFrame:
    """(project_id, file, sheet, header, n_rows, first_rows, kind) of each sheet: its detected header, the number of rows below it, the first of these, and whether it
    is a table of fibres, of materials or another, by its name and its file's."""
    keys = ["project_id", "file", "sheet"]
    joined = sheets.join(detect_header(sheets, keys, "row_no", "cells"), keys)
    below = F.col("row_no") - F.col("header_row")
    first = F.sort_array(F.collect_list(F.when(below.between(1, samples), F.struct("row_no", "cells"))))
    out = joined.groupBy(*keys).agg(F.max(F.when(below == 0, F.col("cells"))).alias("header"), F.count_if(below > 0).alias("n_rows"), F.transform(first, lambda r: r["cells"]).alias("first_rows"))
    return out.withColumn("kind", classify_table(F.concat_ws(" ", "file", "sheet")))


def layer_sample(features: DataFrame, n: int = 5) -> DataFrame:
    """The first n features of each layer in their order, with their place and how many the layer has."""
    return numbered(features, ["project_id", "layer"], ["layer_order", "feature_seq", "feature_id"], "place").where(F.col("place") <= n)


def read_sheets_multi(sheets: DataFrame, names: list[str], limit: int = 200) -> DataFrame:
    """The records of the chosen sheets within `limit` rows below their header, with each sheet's total."""
    keys, chosen = ["project_id", "file", "sheet"], sheets.where(F.col("sheet").isin(*names))
    totals = workbook_summary(chosen).select(*keys, F.col("n_rows").alias("total"))
    head = detect_header(chosen, keys, "row_no", "cells")
    return sheet_records(chosen).join(head, keys).where(F.col("row_no") - F.col("header_row") <= limit).drop("header_row").join(totals, keys)


def sheet_pages(sheets: DataFrame, number: int, size: int, word: str | None = None, names: list[str] | None = None) -> DataFrame:
    """(project_id, file, sheet, row_no, record, place, total): one page of the records of each sheet, below its detected header, that hold the word in any cell, in any
    case, with their place among these and how many there are.

    The first thousand rows of a sheet are found by a limited rank, of which a task holds no more than these of a sheet; pages beyond them by a range sort."""
    chosen = sheets if names is None else sheets.where(F.col("sheet").isin(*names))
    records = _below_header(chosen)
    if word:
        records = records.where(F.exists("fields", lambda f: F.contains(F.lower(F.trim(F.get("cells", f["at"]))), F.lit(word.lower()))))
    keys = ["project_id", "file", "sheet"]
    size = min(max(size, 1), 1000)
    on_page = F.col("place").between((number - 1) * size + 1, number * size)
    if number * size > 1000:
        return numbered(records, keys, ["row_no"], "place").where(on_page).select(*keys, "row_no", _record(), "place", "total")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))
    rows = records.withColumn("place", place).where(on_page).select(*keys, "row_no", _record(), F.col("place").cast("bigint").alias("place"))
    totals = records.groupBy(*keys).agg(F.count("*").alias("total"))
    return rows.join(totals, keys).select(*keys, "row_no", "record", "place", "total")


def read_domain_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct first entries, parted by ; or , of reference lists; the first line of a file is a header."""
    lines = spark.read.option("header", True).option("sep", "\u0001").csv(paths)
    first = F.trim(F.split(F.regexp_replace(F.col(lines.columns[0]), "﻿", ""), "[;,]")[0])
    return lines.select(first.alias("entry")).where("entry <> ''").distinct()


def union_soft_deleted(live: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deleted records join the live ones, marked, without geometry."""
    deleted = deleted.withColumn("rings", F.lit(None).cast(f"array<{geo.COORDS}>")) if "rings" in live.columns else deleted.drop("rings")
    gone = deleted.withColumn("is_deleted", F.lit(True)).withColumn("coords", F.lit(None).cast(geo.COORDS)).withColumn("geom_type", F.lit(None).cast("string"))
    return live.unionByName(gone, allowMissingColumns=True)


def supplement_codes(features: DataFrame) -> DataFrame:
    return features.select("project_id", null_if_token(F.col("props")["CODE"]).alias("code")).dropna().distinct()


def write_issues(issues: DataFrame, path: str) -> None:
    """One folder a project; rows of a project are gathered first, so that a project has few files."""
    issues.repartition("project_id").write.mode("overwrite").partitionBy("project_id").parquet(path)
