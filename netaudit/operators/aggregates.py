"""Uniqueness, rollups, catalogues and summaries of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.operators.ranks import quantile


def repeated_codes(rows: DataFrame, code: Column, keys: list[str], id_col: str) -> DataFrame:
    """(keys…, code, n, first_id) of codes that occur more than once in their scope; null codes are left out."""
    return rows.withColumn("code", code).where("code IS NOT NULL").groupBy(*keys, "code").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def rollup_over(owners: DataFrame, owner: str, demand: DataFrame, demand_owner: str, need: Column, supply: DataFrame, supply_owner: str, have: Column, skip_zero: bool = False) -> DataFrame:
    """(owner, needed, held): sums of either side by owner, null as 0, with passed. skip_zero leaves out owners that need nothing."""
    n = demand.groupBy(F.col(demand_owner).alias("_n")).agg(F.sum(need).alias("needed"))
    h = supply.groupBy(F.col(supply_owner).alias("_h")).agg(F.sum(have).alias("held"))
    out = owners.select(F.col(owner).alias("owner")).distinct().join(n, F.col("owner") == F.col("_n"), "left").join(h, F.col("owner") == F.col("_h"), "left")
    out = out.select("owner", F.coalesce("needed", F.lit(0)).alias("needed"), F.coalesce("held", F.lit(0)).alias("held")).withColumn("passed", F.col("needed") <= F.col("held"))
    return out.where("needed <> 0") if skip_zero else out


def over_limit(rows: DataFrame, used: Column, limit: Column) -> DataFrame:
    return rows.where(used > limit)


def distinct_over(rows: DataFrame, keys: list[str], value: str, limit: Column) -> DataFrame:
    """Groups with more distinct values than their limit; null counts as one value."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("n"), F.max(limit).alias("most")).where("n > most")


def layer_catalog(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """(layer, n, kind, crs) of each wanted layer: its rows, and kind and reference system of its first feature; 0 and null where it is missing."""
    have = features.groupBy("layer").agg(F.count("*").alias("n"), F.min_by("geom_type", "feature_seq").alias("kind"), F.min_by("crs", "feature_seq").alias("crs"))
    return wanted.join(have, "layer", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def severity_counts(issues: DataFrame, keys: list[str]) -> DataFrame:
    return issues.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warning"),
        F.count_if(~F.col("passed") & F.col("severity").isin("error", "fatal")).alias("failed"), F.count_if("passed").alias("passed"),
    )


def category_counts(issues: DataFrame) -> DataFrame:
    """Failures by category and severity, with totals of either and of all (null)."""
    return issues.where("NOT passed").cube("problem_category", "severity").agg(F.count("*").alias("n"))


def rule_summary(issues: DataFrame, samples: int = 5) -> DataFrame:
    """Per rule: rows, warnings, failures, and the first failed objects by name."""
    w = Window.partitionBy("rule_id").orderBy("object_id")
    failed = issues.where("NOT passed").select("rule_id", "object_id").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples)
    first = failed.groupBy("rule_id").agg(F.array_join(F.sort_array(F.collect_list("object_id")), ",").alias("samples"))
    counts = issues.groupBy("rule_id").agg(F.count("*").alias("total"), F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warnings"), F.count_if(~F.col("passed") & (F.col("severity") != "warning")).alias("failed"))
    return counts.join(first, "rule_id", "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def serious_issues(issues: DataFrame, order: list[str], bulk_rule: str = "R019", objects: int | None = None, most: int = 100) -> DataFrame:
    """Fatal failures, and those of the bulk rule if they exceed half the objects; the first `most` in order, with how many there are."""
    failed = issues.where("NOT passed")
    bulk = failed.groupBy().agg(F.count_if(F.col("rule_id") == bulk_rule).alias("_b"))
    kept = failed.join(F.broadcast(bulk), how="cross").where((F.col("severity") == "fatal") | ((F.col("rule_id") == bulk_rule) & (F.col("_b") > (objects or 0) / 2))).drop("_b")
    total = kept.groupBy().agg(F.count("*").alias("of"))
    return kept.orderBy(*order).limit(most).join(F.broadcast(total), how="cross")


def distance_stats(edges: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys…, n, least, median, most) of each group's distances, to three decimals. The median comes from ranks of a range sort, so no task holds a group's values."""
    keys = keys or []
    sums = edges.groupBy(*keys).agg(F.count(column).alias("n"), F.round(F.min(column), 3).alias("least"), F.round(F.max(column), 3).alias("most"))
    middle = quantile(edges, keys, column).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.round("quantile", 3).alias("median"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    return sums.join(middle, on, "left").select(*keys, "n", "least", "median", "most")


def accuracy(expected: DataFrame, hit: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives and false negatives of hit against expected, with precision, recall and F1."""
    e, h = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), hit.select(*keys).distinct().withColumn("_h", F.lit(1))
    c = e.join(h, keys, "full").agg(F.count_if(F.col("_e").isNotNull() & F.col("_h").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_h").isNull()).alias("fn"))
    rate = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(rate(2 * p * r, p + r), 6).alias("f1"))


def coverage_share(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """How many of the wanted keys there are, how many are had, and the share."""
    w = wanted.select(key).distinct().join(have.select(key).distinct().withColumn("_h", F.lit(1)), key, "left")
    return w.agg(F.count("*").alias("wanted"), F.count("_h").alias("had"), F.round(F.count("_h") / F.count("*"), 6).alias("share"))


def missing_from(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")


def baseline_difference(issues: DataFrame, expected: DataFrame) -> DataFrame:
    """Rules whose number of issues differs from the expected (rule_id, n)."""
    got = issues.groupBy("rule_id").agg(F.count("*").alias("got"))
    return got.join(expected.withColumnRenamed("n", "want"), "rule_id", "full").select("rule_id", F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("want", F.lit(0)).alias("want")).where("got <> want")


def device_stats(features: DataFrame) -> DataFrame:
    """Rows per layer and in all (null)."""
    return features.rollup("layer").agg(F.count("*").alias("n"))
