"""Lookups on features and knowledge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaudit.functions import geo
from netaudit.operators.windows import detect_header


def device_lookup(features: DataFrame, codes: DataFrame, crs: str | None = None) -> DataFrame:
    """The first feature, in layer order, of each wanted code, reprojected if asked."""
    found = features.join(codes.select("code"), "code", "left_semi")
    first = found.groupBy("project_id", "code").agg(F.min_by(F.struct("layer", "coords", "crs", "props"), F.struct("layer_order", "feature_seq")).alias("f")).select("project_id", "code", "f.*")
    return first.withColumn("coords", geo.reproject(F.col("coords"), F.col("crs"), crs)) if crs else first


def trace(cables: DataFrame, codes: DataFrame) -> DataFrame:
    """Cables that have a wanted code at either end."""
    ends = cables.select("*", F.explode(F.array_distinct(F.array("start_code", "end_code"))).alias("_end"))
    return ends.join(codes.select(F.col("code").alias("_end")).distinct(), "_end").withColumnRenamed("_end", "traced")


def cable_length(given: Column, coords: Column) -> Column:
    return F.coalesce(given, geo.line_length(coords))


def search(rows: DataFrame, word: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with a word in any column, in any case."""
    return rows.where(F.exists(F.array(*[F.lower(F.col(c).cast("string")) for c in columns or rows.columns]), lambda c: F.coalesce(F.contains(c, F.lit(word.lower())), F.lit(False))))


def construction_kb(procedures: DataFrame, materials: DataFrame, object_type: str = "", material_code: str = "") -> tuple[DataFrame, DataFrame]:
    p = search(procedures, object_type) if object_type else procedures
    return p, materials.where(F.col("material_code") == material_code) if material_code else materials


def fiber_sheets(sheets: DataFrame) -> DataFrame:
    """All rows of the sheets that allocate cores."""
    return sheets.where(F.col("sheet").contains("纤芯连接与分配") | F.lower("sheet").rlike("fiber|fibre|纤芯") | F.col("sheet").rlike("^(SRO|BPE|PBO)[-_]"))


def bom_codes(sheets: DataFrame) -> DataFrame:
    """Material codes of bill sheets, each file and sheet by its own detected header: the first column whose header holds CODE or 编码, else the first column."""
    keys = [k for k in ("project_id", "file", "sheet") if k in sheets.columns]
    bill = sheets.where(F.col("sheet").rlike("(?i)BOM|物料"))
    named = F.array_position(F.transform("cells", lambda c: F.coalesce(F.upper(c).contains("CODE") | c.contains("编码"), F.lit(False))), F.lit(True))
    heads = bill.join(detect_header(bill, keys, "row_no", "cells"), keys).where("row_no = header_row")
    at = heads.select(*keys, "header_row", F.coalesce(F.nullif(named, F.lit(0)), F.lit(1)).cast("int").alias("at"))
    rows = bill.join(at, keys).where("row_no > header_row")
    return rows.select("project_id", F.trim(F.get("cells", F.col("at") - 1)).alias("code")).where("code <> ''").distinct()
