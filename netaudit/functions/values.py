"""Normalisation of mixed values, codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netaudit import config


def null_if_token(c: Column) -> Column:
    return F.when(c.isin(*config.NULL_TOKENS), None).otherwise(c)


def is_missing(c: Column, tokens: tuple[str, ...] = config.MISSING) -> Column:
    return c.isNull() | (F.trim(c) == "") | F.upper(F.trim(c)).isin(*tokens)


def first_present(*columns: Column, nonblank: bool = True) -> Column:
    """The first column that is not null, or not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) if nonblank else c for c in columns])


def number(c: Column) -> Column:
    """Number in a text with a decimal comma, blanks or underscores; null if it is none."""
    return F.regexp_replace(F.regexp_replace(c, "[ _]", ""), ",", ".").try_cast("double")


def rounded(c: Column, digits: int) -> Column:
    """A number from 0 on with so many decimals, as SQL has it for doubles: the nearest whole number of units. round() goes by the decimal digits of each number, at ten times the cost; it does what is left."""
    unit = float(10**digits)
    return F.when((c >= 0) & (c < 2**52 / unit), F.floor(c * unit + 0.5) / unit).otherwise(F.round(c, digits))


def is_int_like(c: Column) -> Column:
    v = number(c)
    return F.coalesce(v == F.floor(v), F.lit(False))


def is_number_like(c: Column) -> Column:
    return number(c).isNotNull()


def first_digits(c: Column) -> Column:
    """The first run of digits, as 12 of 12-24FO."""
    return F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit("")).try_cast("bigint")


def all_digits(c: Column) -> Column:
    """All digits joined, as 1224 of 12-24FO."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def effective_length(c: Column, strip_prefix: bool = False, strip_increment: bool = False) -> Column:
    """Length of a value as text: trimmed, an integral float without its .0, and if asked without code prefix or end number."""
    t = F.regexp_replace(F.trim(c), r"^(-?[0-9]+)\.0+$", "$1")
    if strip_prefix:
        t = F.regexp_replace(t, "^[A-Z]{2,4}-[A-Z]{2,6}-", "")
    if strip_increment:
        t = F.regexp_replace(t, "-[0-9]{3}$", "")
    return F.char_length(t)


def is_root_code(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike("^(" + "|".join(config.ROOT_CODES) + ")"), F.lit(False))


def template_regex(prefix: list[tuple[str, int, int]], body: list[tuple[str, int, int, bool]], separator: str = "-") -> str:
    """One anchored regex of a code template: prefix segments (characters, least, most), then body segments, the last of which may be optional
    or repeat: (characters, least, most, optional)."""
    part = [f"([{c}]{{{a},{b}}})" for c, a, b in prefix]
    out = separator.join(part)
    for c, a, b, optional in body:
        out += f"(?:{separator}([{c}]{{{a},{b}}}))?" if optional else f"{separator}([{c}]{{{a},{b}}})"
    return f"(?i)^{out}$"


#: The two code formats in use.
CABLE_CODE = template_regex([("A-Z", 2, 4), ("A-Z", 2, 6)], [("A-Z0-9", 1, 5, False), ("A-Z0-9", 1, 5, False), ("A-Z0-9", 1, 5, False), ("0-9", 3, 3, True)])
GENERIC_CODE = r"(?i)^([A-Z]{2,6})-([A-Z0-9]{2,8})-([A-Z0-9]{1,60}(?:-[A-Z0-9]{1,60})*)$"


def match_code(c: Column, regex: str, groups: int) -> Column:
    """The segments of a code as an array, null if it doesn't have that format."""
    return F.when(c.rlike(regex), F.array(*[F.regexp_extract(c, regex, k) for k in range(1, groups + 1)]))


def box_type(kind: Column, function: Column, code: Column) -> Column:
    return F.upper(F.coalesce(F.when(F.trim(kind) != "", F.trim(kind)), F.when(F.trim(function) != "", F.trim(function)), F.nullif(F.regexp_extract(F.upper(code), "^(PBO|BPE|BPI)", 1), F.lit(""))))


def voltage_class(c: Column) -> Column:
    """Upper kilovolts of the class that a voltage text falls in; 10 if it names none."""
    out = None
    for word, kv in (("1000", 1000), ("750", 750), ("500", 500), ("330", 330), ("220", 220), ("110", 110), ("35", 110)):
        out = F.when(c.contains(word), kv) if out is None else out.when(c.contains(word), kv)
    return out.otherwise(10)


def normalize_reuse(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin(*config.REUSED), "yes").otherwise("no")


def canonical_layer(c: Column) -> Column:
    u = F.upper(F.trim(c))
    out = F.when(u.isin(*config.LAYERS), u)
    for alias, name in config.LAYER_ALIASES.items():
        out = out.when(u == alias, name)
    return out.otherwise(c)


def is_reference_table(layer: Column) -> Column:
    return F.upper(layer).startswith("L_") | F.upper(layer).startswith("TYPE")


def sheet_layer(name: Column) -> Column:
    """Official layer of a sheet: equal name, name_…, …_name, then contained; lookup tables have none."""
    u = F.upper(F.trim(name))
    cases = [(u == n, n) for n in config.LAYERS] + [(u.startswith(f"{n}_") | u.endswith(f"_{n}"), n) for n in config.LAYERS] + [(u.contains(n), n) for n in config.LAYERS]
    out = F.when(is_reference_table(name), None)
    for test, n in cases:
        out = out.when(test, n)
    return out


def classify_table(name: Column) -> Column:
    return F.when(F.lower(name).rlike("fiber|fibre|纤芯|core"), "fiber").when(F.lower(name).rlike("bom|物料|material"), "bom").otherwise("other")


def classify_package(name: Column, suffixes: Column) -> Column:
    """Kind of a package by the words of its name, then by what it holds."""
    n, has = F.lower(name), lambda *s: F.arrays_overlap(suffixes, F.array(*map(F.lit, s)))
    gis = has("shp", "gpkg", "qgs", "qgz")
    return (
        F.when(n.rlike("survey|场勘"), "survey_design").when(n.rlike("bom|物料"), "as_built_bom").when(n.rlike("fiber|纤芯"), "design_fiber").when(n.rlike("procedure|工序"), "procedure")
        .when(n.rlike("spec|规范") & ~gis, "layer_spec").when(gis, "full_design").when(has("xlsx", "xls", "csv"), "spreadsheet").otherwise("unknown")
    )


def project_type(category: Column) -> Column:
    return F.when(category == "survey_design", "survey_design").when(category.isin("full_design", "design_fiber"), "full_design").when(category.isin("as_built", "as_built_bom"), "as_built").otherwise("unknown")


def get_ci(props: Column, key: str) -> Column:
    """Value of a map by key, else by the key in any case."""
    return F.coalesce(F.try_element_at(props, F.lit(key)), F.get(F.map_values(F.map_filter(props, lambda k, v: F.upper(k) == key.upper())), F.lit(0)))


def lookup(c: Column, values: dict[str, str], other: str) -> Column:
    """Value of a short fixed table."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(other))


def severity_of(rule: Column, own: Column | None = None) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in config.SEVERITY.items() for x in kv]), rule)
    return F.coalesce(known, *([own] if own is not None else []), F.lit("warning"))


def category_of(rule: Column) -> Column:
    return lookup(rule, config.CATEGORY, config.OTHER_CATEGORY)
