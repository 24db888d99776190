"""Relational checks: references, orphans, both-sided coverage, capacities, routes, text matches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from netaudit.functions.values import is_root_code


def join_heads(rows: DataFrame, heads: DataFrame, keys: list[str], most: int = 20_000) -> DataFrame:
    """Inner join of rows with heads, a written table of one row a key. Up to `most` heads are broadcast, so rows stay where they are however many a key has; rows meet more heads
    by the key, and heads are hashed, so rows are not sorted."""
    few = heads.limit(most + 1).count() <= most
    return rows.join(F.broadcast(heads) if few else heads.hint("shuffle_hash"), keys)


def unpivot_ends(rows: DataFrame, ends: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row (keep…, side, ref) for each non-blank end."""
    pairs = F.array(*[F.struct(F.lit(side).alias("side"), c.cast("string").alias("ref")) for side, c in ends.items()])
    return rows.select(*keep, F.explode(pairs).alias("_e")).select(*keep, "_e.*").where("ref IS NOT NULL AND trim(ref) <> ''")


def orphans(child: DataFrame, child_key: list[str], parent: DataFrame, parent_key: list[str], exempt: Column | None = None) -> DataFrame:
    """Rows of child whose key is not in parent; rows with a null key, and exempt rows, are left out."""
    keys = parent.select(*[F.col(p).alias(f"_p{k}") for k, p in enumerate(parent_key)]).distinct()
    rows = child.dropna(subset=child_key)
    rows = rows.where(~F.coalesce(exempt, F.lit(False))) if exempt is not None else rows
    return rows.join(keys, [F.col(c) == F.col(f"_p{k}") for k, c in enumerate(child_key)], "left_anti")


def unreferenced(parent: DataFrame, parent_key: list[str], child: DataFrame, child_key: list[str]) -> DataFrame:
    """Rows of parent that no row of child refers to."""
    return orphans(parent, parent_key, child, child_key)


def bidirectional(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], key: str = "key") -> DataFrame:
    """(side, key): codes of the left that the right lacks, and the other way. Several key columns of a side are alternatives: a left code is covered by any
    of the right's, and a right row is covered if any of its own is."""
    rows = lambda df, keys: df.select(F.monotonically_increasing_id().alias("_row"), F.explode(F.array(*[F.col(k).cast("string") for k in keys])).alias(key)).dropna(subset=[key])
    codes = lambda df, keys: df.select(F.explode(F.array(*[F.col(k).cast("string") for k in keys])).alias(key)).dropna().distinct()
    lc, rc = codes(left, left_keys), codes(right, right_keys)
    missing = lc.join(rc, key, "left_anti").select(F.lit("left").alias("side"), key)
    if len(right_keys) == 1:
        return missing.unionByName(rc.join(lc, key, "left_anti").select(F.lit("right").alias("side"), key))
    covered = rows(right, right_keys).join(lc.withColumn("_ok", F.lit(1)), key, "left").groupBy("_row").agg(F.max("_ok").alias("_ok"), F.min_by(key, key).alias(key))
    return missing.unionByName(covered.where("_ok IS NULL").select(F.lit("right").alias("side"), key))


def first_match(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first row, or the last, of each key in an order that ends in a unique column. An aggregate with map-side partial results, so a hot key is not one task's."""
    pick, rest = (F.max_by if last else F.min_by), [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return one.select(*keys, "_row.*").select(*rows.columns)


def resolve(edges: DataFrame, keys: dict[str, str], devices: DataFrame, code: str, columns: list[str]) -> DataFrame:
    """edges with the device columns of each end, prefixed by the side; null where an end is unresolved."""
    out = edges
    for side, column in keys.items():
        d = devices.select(F.col(code).alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(d, out[column] == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out


def capacity_over(rows: DataFrame, key: str, need: Column, holders: DataFrame, holder_key: str, capacity: Column) -> DataFrame:
    """Rows that need more than the capacity of what they refer to; capacity 0 or null says nothing."""
    h = holders.select(F.col(holder_key).alias("_k"), capacity.alias("held")).where("held > 0")
    return rows.withColumn("needed", need).join(h, F.col(key) == F.col("_k")).where("needed > held").drop("_k")


def coverage(boxes: DataFrame, code: str, capacity: Column, users: DataFrame, ref: str, amount: Column, order: list[str], how: str = "last") -> DataFrame:
    """(code, held, needed) of boxes with less capacity than the last user of each code needs, or all its users together (how='sum')."""
    value = F.max_by(amount, F.struct(*order)) if how == "last" else F.sum(amount)
    need = users.dropna(subset=[ref]).groupBy(F.col(ref).alias("code")).agg(value.alias("needed")).where("needed > 0")
    return boxes.select(F.col(code).alias("code"), capacity.alias("held")).join(need, "code").where("held < needed")


def same_route_pairs(rows: DataFrame, route: list[str], code: str, seq: str) -> DataFrame:
    """(route…, first, second): unordered pairs of rows with the same route and different codes. Routes with one row meet no other; the join is on the
    route, so a busy route costs its own pairs, which are the result."""
    a = rows.select(*route, F.col(code).alias("first"), F.col(seq).alias("_s1"))
    b = rows.select(*route, F.col(code).alias("second"), F.col(seq).alias("_s2"))
    return a.join(b, route).where("_s1 < _s2 AND first <> second").drop("_s1", "_s2")


def in_domain(values: DataFrame, column: str, domain: DataFrame, entry: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, value): distinct values that the list of the same keys doesn't know: neither equal in any case, nor one contained in the other, nor alike in their
    first words (parted by blanks, ; or ,). Blank entries are left out; a blank value is contained in every entry, so it is known if there is any. Keys without an entry judge nothing.

    Only distinct values that aren't equal go on, and they meet entries by equality alone: by first words, and by runs of characters as in contained_codes, once
    for entries in values and once for values in entries. So neither side is broadcast, and lists may be of any size."""
    upper = lambda df, c, name: df.select(*keys, F.trim(F.upper(F.col(c))).alias(name))
    mine = values.select(*keys, F.col(column).alias("value")).where("value IS NOT NULL").distinct().withColumn("_v", F.trim(F.upper("value")))
    known = upper(domain, entry, "_v").where("_v <> ''").distinct()
    any_ = known.select(*keys, F.lit(True).alias("_any")).distinct() if keys else known.select(F.lit(True).alias("_any")).limit(1)
    mine = mine.join(any_, list(keys), "left_semi") if keys else mine.join(any_, F.col("_any"), "left_semi")
    word = lambda c: F.split(F.split(c, r"\s+")[0], "[;,]")[0]
    left = mine.where("_v <> ''").join(known, [*keys, "_v"], "left_anti").withColumn("_w", word(F.col("_v")))
    left = left.join(known.select(*keys, word(F.col("_v")).alias("_w")).distinct(), [*keys, "_w"], "left_anti").select(*keys, "value", "_v")
    holds = contained_codes(left, "_v", known, "_v", list(keys)).select(*keys, F.col("text").alias("_v"))
    within = containing(known, "_v", left, "_v", list(keys)).select(*keys, F.col("code").alias("_v"))
    return left.join(holds.unionByName(within).distinct(), [*keys, "_v"], "left_anti").select(*keys, "value")


def longest_in_text(texts: DataFrame, id_col: str, text_col: str, codes: DataFrame, code_col: str, words: int = 4) -> DataFrame:
    """(id, code): for each text the longest code that it contains, wherever it begins or ends. Texts and codes meet on runs of words: a code's words
    but the first and the last, up to `words` of them, stand whole in every text that contains it. Codes of one or two words meet on their first characters, up to
    three. Containment is then tested, so no text meets all codes."""
    split = lambda c: F.filter(F.split(F.regexp_replace(c, r"\s+", " "), " "), lambda x: x != "")
    listed = codes.select(F.col(code_col).alias("code")).where("code <> ''").distinct().withColumn("_w", split(F.col("code")))
    inner = F.greatest(F.lit(0), F.least(F.size("_w") - 2, F.lit(words)))
    key = F.when(inner > 0, F.array_join(F.slice("_w", 2, inner), " ")).otherwise(F.substring("code", 1, 3))
    heads = listed.select("code", F.when(inner > 0, inner).otherwise(-F.least(F.char_length("code"), F.lit(3))).alias("_k"), F.xxhash64(key).alias("_h"))
    kinds = sorted(r[0] for r in heads.select("_k").distinct().collect())  # at most words + 3

    def grams(k: int) -> Column:
        if k > 0:
            n, part = F.size("_w") - k + 1, lambda i: F.array_join(F.slice("_w", i, k), " ")
        else:
            n, part = F.char_length("_t") + k + 1, lambda i: F.substring(F.col("_t"), i, F.lit(-k))
        runs = F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(part(i)))))
        return F.coalesce(F.transform(runs, lambda h: F.struct(F.lit(k).alias("_k"), h.alias("_h"))), F.array().cast("array<struct<_k:int,_h:bigint>>"))

    worded = texts.select(F.col(id_col), F.col(text_col).alias("_t"), F.explode(F.array(split(F.col(text_col)))).alias("_w"))  # words are cut once a row
    seen = worded.select(id_col, "_t", F.explode(F.concat(F.array().cast("array<struct<_k:int,_h:bigint>>"), *[grams(k) for k in kinds])).alias("_g")).select(id_col, "_t", "_g.*")
    met = seen.join(heads, ["_k", "_h"]).where(F.contains("_t", F.col("code")))
    return met.groupBy(id_col).agg(F.max_by("code", F.struct(F.char_length("code"), "code")).alias("code"))


def _met_codes(texts: DataFrame, text_col: str, codes: DataFrame, code_col: str, keys: list[str], width: int = 24) -> DataFrame:
    """(keys…, text, code): codes and the texts that contain them, see contained_codes."""
    listed = codes.select(*keys, F.col(code_col).alias("code")).where("trim(code) <> ''").distinct()
    whole = listed.where(F.char_length("code") <= width).select(*keys, "code", F.col("code").alias("_run"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("code") - (width - 1)), lambda k: F.substring("code", k, F.lit(width))))
    each = listed.where(F.char_length("code") > width).select(*keys, "code", F.explode(runs).alias("_run"))
    rare = each.groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    long = each.join(rare.hint("merge"), [*keys, "_run"]).groupBy(*keys, "code").agg(F.min(F.struct("_n", "_run")).alias("_h")).select(*keys, "code", F.col("_h._run").alias("_run"))
    heads = whole.unionByName(long)
    # what runs begin with, and how long they are: one small row of the keys, which spares texts the runs that are listed nowhere
    starts = heads.groupBy(*keys, F.substring("_run", 1, 2).alias("_s")).agg(F.collect_set(F.char_length("_run")).alias("_w"))
    starts = starts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_w"))).alias("_starts"))
    # texts are the work, however few bytes they are, so they are dealt to as many tasks as a shuffle has; lists of codes are not broadcast
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = texts.select(*keys, F.col(text_col).alias("text")).where("text <> ''").repartition(parts, *keys, "text").distinct()
    said = said.join(F.broadcast(starts), keys) if keys else said.crossJoin(starts)  # one row
    none, n = F.array().cast("array<int>"), F.char_length("text")

    def at(k: Column) -> Column:
        pair, one = (F.try_element_at("_starts", F.substring("text", k, F.lit(w))) for w in (2, 1))
        widths = F.concat(F.when(k < n, F.coalesce(pair, none)).otherwise(none), F.coalesce(one, none))
        return F.transform(F.filter(widths, lambda w: k + w <= n + 1), lambda w: F.substring("text", k, w))

    asked = said.select(*keys, "text", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), at)))).alias("_run"))
    return asked.join(heads.hint("merge"), [*keys, "_run"]).where(F.contains("text", F.col("code")))


def contained_codes(texts: DataFrame, text_col: str, codes: DataFrame, code_col: str, keys: list[str]) -> DataFrame:
    """(keys…, text, code): for each distinct text and keys the longest code of the same keys that it contains, wherever that begins or ends; of equally long
    codes the first in code-point order. Blank codes are left out, texts without a code don't appear.

    Every code of up to 24 characters is listed under itself, a longer one under that of its runs of 24 which the fewest codes of its keys hold. A text asks for those of its
    runs that begin and are as long as a listed one, so it meets the codes that it contains, however many codes share their parts."""
    met = _met_codes(texts, text_col, codes, code_col, keys)
    return met.groupBy(*keys, "text").agg(F.min_by("code", F.struct(-F.char_length("code"), "code")).alias("code"))


def containing(texts: DataFrame, text_col: str, codes: DataFrame, code_col: str, keys: list[str]) -> DataFrame:
    """(keys…, code): distinct codes of at least one character that some text of the same keys contains."""
    return _met_codes(texts, text_col, codes, code_col, keys).select(*keys, "code").distinct()


def shared_tokens(left: DataFrame, left_col: str, right: DataFrame, right_col: str, regex: str) -> DataFrame:
    """Distinct tokens by a regex that occur on both sides."""
    tokens = lambda df, c: df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(regex), F.lit(0)))).alias("token")).distinct()
    return tokens(left, left_col).join(tokens(right, right_col), "token", "left_semi")


def self_loops(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    return rows.where(start == end)


def unmapped(fields: DataFrame, known: DataFrame) -> DataFrame:
    """(layer, field) that no mapping of the layer names."""
    return fields.select("layer", "field").distinct().join(known.select("layer", F.upper("candidate").alias("_c")).distinct(), (fields["layer"] == known["layer"]) & (F.upper("field") == F.col("_c")), "left_anti")


@F.pandas_udf(DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks of two texts, 0 to 1."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def suggest(fields: DataFrame, known: DataFrame, least: float = 0.82, longest: int = 6) -> DataFrame:
    """(layer, field, suggestion, score): the official name whose candidate is equal, else most alike, at least `least` if the longer name has `longest`
    letters. Only distinct names meet the layer's few candidates."""
    f, k = fields.select("layer", "field").distinct(), known.select("layer", "official", "candidate").distinct()
    met = f.join(F.broadcast(k), "layer").withColumn("score", F.when(F.upper("field") == F.upper("candidate"), 1.0).otherwise(similarity(F.upper("field"), F.upper("candidate"))))
    good = met.where((F.col("score") == 1) | ((F.col("score") >= least) & (F.greatest(F.char_length("field"), F.char_length("candidate")) >= longest)))
    return good.groupBy("layer", "field").agg(F.max_by(F.struct(F.col("official").alias("suggestion"), "score"), F.struct("score", "official")).alias("s")).select("layer", "field", "s.*")


def root_exempt(code: Column) -> Column:
    return is_root_code(code)
