"""Nested parameters of many projects: JSON objects flattened to paths, merged at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaudit.operators.cut import cut

_TREE = "map<string,variant>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def flatten(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys…, path, value) for each leaf of the JSON objects: path is the array of names that lead to it and value its JSON text. Lists are leaves, and so are objects without a
    member. Texts that are no JSON object, broken ones and nulls, give nothing. One round for each level."""
    tree = F.try_parse_json(F.col(json))
    todo = cut(rows.select(*keys, F.array().cast("array<string>").alias("path"), tree.alias("v")).where(_kind(F.col("v")).startswith("OBJECT")).select(*keys, "path", F.to_json("v").alias("value")))
    leaves = []
    while True:
        v = F.try_parse_json("value")
        inner = _kind(v).startswith("OBJECT") & (F.col("value") != "{}")
        leaves.append(todo.where(~inner))
        members = todo.where(inner).select(*keys, "path", F.explode(F.variant_get(v, "$", _TREE)).alias("_name", "_v"))
        # a JSON null is a null of the map
        todo = cut(members.select(*keys, F.concat("path", F.array("_name")).alias("path"), F.coalesce(F.to_json("_v"), F.lit("null")).alias("value")))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def merge(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, path, value): leaves of base and override, as flatten() has them, where objects are merged member by member at any depth and anything else of the override
    takes the place of what base has there. Keys without an override keep the base.

    A leaf of the base goes if the override has a leaf at its path or above it (an object without a member changes no object), or anything below it. Paths meet by equality of
    their beginnings."""
    begins = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.slice(p, 1, k))
    empty = F.col("value") == "{}"
    known = override.where(F.size("path") > 0)
    above = known.select(*keys, F.col("path").alias("_at"), empty.alias("_empty")).distinct()
    below = known.select(*keys, F.explode(F.filter(begins(F.col("path")), lambda b: F.size(b) < F.size("path"))).alias("path")).distinct()
    each = base.where(F.size("path") > 0).select(*keys, "path", "value", F.explode(begins(F.col("path"))).alias("_at"))
    covered = each.join(above, [*keys, "_at"]).where((F.col("_at") == F.col("path")) | ~F.col("_empty")).select(*keys, "path").distinct()
    kept = base.where(F.size("path") > 0).join(covered, [*keys, "path"], "left_anti").join(below, [*keys, "path"], "left_anti")
    # an object without a member takes the place of a value, but not of an object with members
    held = base.select(*keys, F.explode(F.filter(begins(F.col("path")), lambda b: F.size(b) < F.size("path"))).alias("path")).distinct()
    own = known.where(~empty).unionByName(known.where(empty).join(held, [*keys, "path"], "left_anti"))
    return kept.select(*keys, "path", "value").unionByName(own.select(*keys, "path", "value"))


def business_params(projects: DataFrame, defaults: str, json: str = "params") -> DataFrame:
    """(project_id, path, value): the parameters of each project(project_id, params), the JSON text of its own merged over the defaults; projects whose text is
    missing, broken or no object have the defaults."""
    base = flatten(projects.select("project_id", F.lit(defaults).alias("_json")), ["project_id"], "_json")
    return merge(base, flatten(projects, ["project_id"], json), ["project_id"])
