"""Repeats, carried values, pages and header rows of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.operators.cut import cut
from netaudit.operators.joins import join_heads


def repeat_of_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each later row of a key with the first row's number; n equal rows give n - 1. First rows come from an aggregate, so a hot key is not one task's."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("first_row"), F.max(order).alias("_last"))
    a = first.where("_last > first_row").select(*[F.col(k).alias(f"_{k}") for k in keys], "first_row")
    return rows.join(a, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).where(F.col(order) > F.col("first_row")).drop(*[f"_{k}" for k in keys])


def fill_down(rows: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Blank cells take the last value above them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.when(F.trim(F.col(c)) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})


def detect_header(rows: DataFrame, keys: list[str], row_no: str, cells: str, within: int = 10) -> DataFrame:
    """(keys…, header_row) of each sheet, from its first `within` rows: row 1 if it has five filled cells or the most; else the first row with the most cells
    without a digit, if they are five and twice row 1's; else the first row with the most cells, if the lead is five and twice; else row 1."""
    filled = F.filter(F.col(cells), lambda c: F.trim(c) != "")
    top = rows.where(F.col(row_no) <= within).select(*keys, F.col(row_no).alias("_r"), F.size(filled).alias("_n"), F.size(F.filter(filled, lambda c: ~c.rlike("[0-9]"))).alias("_t"))
    g = top.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_n"))).alias("n1"), F.max("_n").alias("nm"), F.max("_t").alias("tm"),
        F.max_by("_r", F.struct("_t", -F.col("_r"))).alias("rt"), F.max_by("_r", F.struct("_n", -F.col("_r"))).alias("rn"),
    )
    n1 = F.coalesce("n1", F.lit(0))
    return g.select(*keys, F.when((n1 >= 5) | (n1 == F.col("nm")), 1).when((F.col("tm") >= 5) & (F.col("tm") >= 2 * n1), F.col("rt")).when((F.col("nm") - n1 >= 5) & (F.col("nm") >= 2 * n1), F.col("rn")).otherwise(1).alias("header_row"))


#: The shapes of fibre sheets, as key columns and the column that exempts a row.
FIBER_SHAPES = ((("所属节点", "托盘编号", "IN"), "光分路器"), (("SRO Port", "ODF Code", "ODF Port"), None), (("Entrée", "N°", "T", "F"), None))


def fiber_core_repeats(sheets: DataFrame) -> DataFrame:
    """sheets(project_id, sheet, row_no, cells): rows that use a fibre core again, with the first row. The header stands in the first eight rows; a sheet takes the
    first shape whose columns it has; rows with a splitter, or with a blank key, are left out."""
    keys = ["project_id", "sheet"]
    trimmed = cut(sheets.where("row_no <= 8")).withColumn("cells", F.transform("cells", lambda c: F.trim(c)))
    shape, at, free = None, None, None
    place = lambda name: F.array_position("cells", F.lit(name)).cast("int") - 1
    for k, (names, exempt) in enumerate(FIBER_SHAPES):
        has = F.size(F.array_except(F.array(*map(F.lit, names)), F.col("cells"))) == 0
        shape = F.when(has, k) if shape is None else shape.when(has, k)
        places = F.array(*map(place, names))
        at = F.when(has, places) if at is None else at.when(has, places)
        free = F.when(has, place(exempt) if exempt else F.lit(-1)) if free is None else free.when(has, place(exempt) if exempt else F.lit(-1))
    heads = trimmed.select(*keys, "row_no", at.alias("at"), free.alias("free"), shape.alias("shape")).where("shape IS NOT NULL")
    best = heads.groupBy(*keys).agg(F.min(F.struct("shape", "row_no", "at", "free")).alias("h")).select(*keys, F.col("h.row_no").alias("head_row"), "h.at", "h.free")
    body = join_heads(sheets, cut(best), keys).where("row_no > head_row")
    cell = lambda k: F.coalesce(F.trim(F.get("cells", k)), F.lit(""))
    rows = body.where(cell(F.col("free")).isin("", "无")).select(*keys, "row_no", F.transform("at", cell).alias("core"))
    rows = rows.where(~F.exists("core", lambda c: c == "")).select(*keys, "row_no", F.array_join("core", "/").alias("core"))
    return repeat_of_first(rows, [*keys, "core"], "row_no")
