"""Field checks from specification tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaudit.functions.values import effective_length, is_int_like, is_missing, is_number_like


def unpivot_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys…, field, value, kind): the named columns of rows as text, with the kind they are stored as."""
    kinds = dict(rows.dtypes)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(kinds[f]).alias("kind")) for f in fields])
    return rows.select(*keys, F.explode(each).alias("_f")).select(*keys, "_f.*")


def required_not_empty(values: DataFrame, required: DataFrame) -> DataFrame:
    return values.join(F.broadcast(required.select("field")), "field", "left_semi").where("value IS NULL OR trim(value) = ''")


def wrong_kind(values: DataFrame, kinds: DataFrame) -> DataFrame:
    """Values of a field whose stored kind is not among those asked for; a text of digits is no number here."""
    return values.join(F.broadcast(kinds.select("field", "allowed")), "field").where("value IS NOT NULL AND NOT array_contains(allowed, kind)")


def wrong_type(values: DataFrame, specs: DataFrame) -> DataFrame:
    """Values that cannot be read as the type asked for: Entier… or Double…; other types and missing values pass."""
    t = F.lower(F.col("type"))
    bad = F.when(t.startswith("entier"), ~is_int_like(F.col("value"))).when(t.startswith("double"), ~is_number_like(F.col("value"))).otherwise(F.lit(False))
    return values.join(F.broadcast(specs.select("field", "type")), "field").where(~is_missing(F.col("value")) & bad)


def too_long(values: DataFrame, specs: DataFrame, numeric: Column | None = None) -> DataFrame:
    """Texts longer than their field allows; numbers are never too long."""
    text = ~F.coalesce(numeric, F.lit(False)) if numeric is not None else F.lit(True)
    v = values.join(F.broadcast(specs.select("field", F.col("length").cast("int").alias("most"))), "field").where(text & ~is_missing(F.col("value")))
    return v.withColumn("n", effective_length(F.col("value"))).where("n > most")


def missing_fields(present: DataFrame, required: DataFrame) -> DataFrame:
    """(layer, field) required but not there: a name counts if it is equal, equal in ten letters, or one is contained in the other."""
    r = required.select("layer", F.upper("field").alias("field")).distinct()
    p = present.select(F.col("layer").alias("_l"), F.upper("field").alias("_p")).distinct()
    alike = (F.substring("field", 1, 10) == F.substring("_p", 1, 10)) | F.contains("field", F.col("_p")) | F.contains("_p", F.col("field"))
    return r.join(F.broadcast(p), (F.col("layer") == F.col("_l")) & alike, "left_anti")


#: Words of a rule's text in their order, and the condition they stand for.
CONDITION_WORDS = (("unique|唯一", "unique"), ("empty|空", "required_not_empty"), ("length|长度", "field_length_check"), ("type|类型", "field_type_check"), ("crs|坐标", "crs_check"), ("naming|命名", "naming"), ("complete|完整", "complete"), ("overlap|重叠", "overlap"), ("contain|包含", "containment"), ("reference|引用", "reference"), ("capacity|容量", "capacity"), ("isolated|孤立", "isolated"))


def classify_condition(text: Column) -> Column:
    out = None
    for words, name in CONDITION_WORDS:
        out = F.when(F.lower(text).rlike(words), name) if out is None else out.when(F.lower(text).rlike(words), name)
    return out.otherwise("manual_review")


def derive_conditions(specs: DataFrame, rules: DataFrame) -> DataFrame:
    """(layer, field, condition) from specifications (layer, field, type, length, required) and rule texts (layer, field, text)."""
    pick = lambda cond, name: specs.where(cond).select("layer", "field", F.lit(name).alias("condition"))
    own = pick("required = 'O'", "required_not_empty").unionByName(pick("type IS NOT NULL", "field_type_check")).unionByName(pick("length IS NOT NULL", "field_length_check"))
    return own.unionByName(rules.select("layer", "field", classify_condition(F.col("text")).alias("condition")))
