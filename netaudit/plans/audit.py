"""A whole audit: rules by project category, spatial and safety rules always, traced and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaudit import config
from netaudit.functions.values import category_of, severity_of
from netaudit.operators.aggregates import severity_counts
from netaudit.operators import joins as J
from netaudit.operators.sheets import check_case, complete_truncated_fields, sheets_to_features, with_suggestion
from netaudit.plans.rules import RULES, Context, prop, run_all, run_each
from netaudit.schema import ISSUES

#: Judged on sheets where there are any.
CASE_RULES = ("R-FILE-001", "R-FLD-001", "R-FLD-002", "R-REL-001", "R-REL-004", "R-DAT-001", "R-FIBER-001", "R-BOM-001")
ALWAYS = [r for r in RULES if r.startswith(("R-GIS", "R-SAFE"))]


def route(issues: DataFrame, projects: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Issues of the rules that hold for their project's category; spatial and safety rules, and those given, hold for all."""
    pairs = [(c, r) for c, rules in config.ROUTES.items() for r in dict.fromkeys([*rules, *ALWAYS, *more])]
    allowed = F.broadcast(issues.sparkSession.createDataFrame(pairs, "category string, rule_id string"))
    return issues.join(projects.select("project_id", "category").distinct(), "project_id").join(allowed, ["category", "rule_id"], "left_semi").drop("category")


def objects_of(features: DataFrame) -> DataFrame:
    """(project_id, code, ref) of the features that have a code: the last in layer order of a code that several have; ref is layer:feature."""
    coded = features.withColumn("code", F.upper(prop("CODE"))).where("code IS NOT NULL AND NOT coalesce(is_deleted, false)")
    last = F.max_by(F.concat_ws(":", "layer", "feature_id"), F.struct("layer_order", "feature_seq", "feature_id"))
    return coded.groupBy("project_id", "code").agg(last.alias("ref"))


def trace_objects(issues: DataFrame, objects: DataFrame) -> DataFrame:
    """Issues with object_ref: of failed ones, the object (project_id, code, ref) with the longest code that the issue's object and message contain, in any case; null
    where there is none. Only distinct texts are searched."""
    said = F.upper(F.concat_ws(" ", "object_type", "object_id", "message"))
    told = issues.withColumn("_said", F.when(~F.col("passed"), said))
    listed = objects.groupBy("project_id", F.upper("code").alias("code")).agg(F.max("ref").alias("object_ref"))
    hit = J.contained_codes(told, "_said", listed, "code", ["project_id"]).join(listed.hint("merge"), ["project_id", "code"]).select("project_id", F.col("text").alias("_said"), "object_ref")
    return told.join(hit.hint("merge"), ["project_id", "_said"], "left").select(*issues.columns, "object_ref")


def case_issues(sheets: DataFrame, known: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """The judgements of check_case as issues."""
    rule = F.col("rule_id")
    values = {"object_type": F.lit("SHEET"), "object_id": F.col("object"), "passed": F.lit(False), "severity": severity_of(rule), "problem_category": category_of(rule)}
    found = check_case(sheets, known, projects)
    fields = [f.split(" ")[0] for f in ISSUES.split(", ")]
    return found.select(*[(values[f] if f in values else F.col(f) if f in found.columns else F.lit(None).cast("string")).alias(f) for f in fields])


def skipped(projects: DataFrame, rule_ids: list[str]) -> DataFrame:
    """(project_id, rule_id): rules that were asked for and don't hold for the project's category, spatial ones of spreadsheets among them."""
    pairs = [(c, r) for c, rules in config.ROUTES.items() for r in rule_ids if r not in rules and not (r in ALWAYS and c != "spreadsheet")]
    spark = projects.sparkSession
    if not pairs:
        return spark.createDataFrame([], "project_id string, rule_id string")
    table = F.broadcast(spark.createDataFrame(pairs, "category string, rule_id string"))
    return projects.select("project_id", "category").distinct().join(table, "category").select("project_id", "rule_id")


def audit(
    features: DataFrame,
    projects: DataFrame,
    params: dict[str, dict] | None = None,
    rule_ids: list[str] | None = None,
    sheets: DataFrame | None = None,
    known: DataFrame | None = None,
    manifest: DataFrame | None = None,
    domains: DataFrame | None = None,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(issues, summary a project) of all projects; projects are (project_id, category).

    Features are those given and those of the sheets, with names that were cut to ten characters completed. Rules that no category asks for are not planned, nor those that rule_ids, if given, leaves out: an
    empty list runs none. Rules on single features share one scan. With sheets, their case is judged too, against the known material codes; with a manifest (project_id,
    name) the files of the layers (R001), with domains (layer, field, entry) the values of fields (R031). Failed issues are traced to objects by
    their codes, and all have a suggestion. With a path, each part is a job of its own and a rule that fails while it runs is a failed row of itself."""
    if sheets is not None:
        features = features.unionByName(from_sheets(sheets), allowMissingColumns=True)
    features = features.withColumn("props", complete_truncated_fields(F.col("props")))
    x = Context(features)
    params = dict(params or {})
    if manifest is not None:
        params["R001"] = {"manifest": manifest} | params.get("R001", {})
    if domains is not None:
        params["R031"] = {"domains": domains} | params.get("R031", {})
    routed = {r for rules in config.ROUTES.values() for r in rules} | set(ALWAYS)
    ids = [r for r in RULES if r in routed] + (["R031"] if domains is not None else []) if rule_ids is None else list(dict.fromkeys(rule_ids))
    if sheets is not None:
        ids = [r for r in ids if r not in CASE_RULES]  # judged once, on the sheets
    elif rule_ids is None:
        ids = [r for r in ids if r in RULES]
    found = run_all(x, ids, params) if path is None else run_each(x, path, ids, params)
    found = route(found, projects, () if domains is None else ("R031",))
    if sheets is not None:
        of_sheets = case_issues(sheets.join(projects.select("project_id"), "project_id", "left_semi"), known, projects)
        found = found.unionByName(of_sheets if rule_ids is None else of_sheets.where(F.col("rule_id").isin(*rule_ids)) if rule_ids else of_sheets.limit(0))
    found = with_suggestion(trace_objects(found, objects_of(features)))
    return found, severity_counts(found, ["project_id"])


def from_sheets(sheets: DataFrame) -> DataFrame:
    """Features of the sheets that are official layers, in the schema of features."""
    f = sheets_to_features(sheets).where(F.upper("layer") != config.BOM_SHEET.upper())
    kinds = F.transform_values("props", lambda k, v: F.lit("string"))
    return f.select("project_id", "layer", F.lit(0).alias("layer_order"), "feature_id", "feature_seq", "props", kinds.alias("prop_types"), F.lit(False).alias("is_deleted"))
