"""Secret scan over a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.llm.common import Scratch, quoted


@dataclass(frozen=True)
class Rule:
    """kind, the regex that spans come from, and what else a match must fulfil: `group` has at least `least` characters.
    The regex must mean the same to Python's parser, which derives the index query, and to Spark, which runs it."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three base patterns of the contract, then the public token formats that the method adds. Where a least
#: length counts from the match's start, the pattern says it itself: a run that is too short holds no longer one.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
)
RULES = BASE + ADDED

Clause = frozenset  # of trigrams that all occur
#: Letters from frequent to rare in English text, a fixed value; it only ranks trigrams by how selective they are.
_FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"
_ANY: frozenset = frozenset({frozenset()})
_MOST = 64


def trigram_query(regex: str) -> frozenset[Clause]:
    """The Boolean trigram query of a regex in disjunctive form: every text with a match holds all trigrams of at least one
    clause, in lower case. The empty clause means that the regex has no mandatory trigram and every text must be read.

    The parse tree is walked once. A node yields the set of exact strings it can match while that set is small, and
    otherwise the query of what it must hold; a sequence joins exact strings of its neighbours."""

    def both(p: frozenset, q: frozenset) -> frozenset:
        out = {a | b for a in p for b in q}
        return frozenset(x for x in out if not any(y < x for y in out)) if len(out) <= _MOST else min(p, q, key=lambda z: (frozenset() in z, len(z)))

    def of_strings(strings: set[str]) -> frozenset:
        found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
        return _ANY if frozenset() in found else found

    def node(op, arg) -> tuple[set[str] | None, frozenset]:
        if op is C.LITERAL:
            return {chr(arg).lower()}, _ANY
        if op is C.IN and arg[0][0] is not C.NEGATE and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}, _ANY
        if op is C.SUBPATTERN:
            return walk(arg[3])
        if op is C.BRANCH:
            kinds = [walk(x) for x in arg[1]]
            if all(s is not None for s, _ in kinds):
                return set().union(*(s for s, _ in kinds)), _ANY
            return None, frozenset().union(*(of_strings(s) if s is not None else q for s, q in kinds))
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            strings, query = walk(sub)
            if strings is not None and high == 1 and low == 0:
                return strings | {""}, _ANY
            return None, _ANY if low == 0 else (of_strings(strings) if strings is not None else query)
        return None, _ANY

    def walk(items) -> tuple[set[str] | None, frozenset]:
        run, query, exact = {""}, _ANY, True
        for op, arg in items:
            strings, q = node(op, arg)
            if strings is not None and len(strings) * len(run) <= _MOST:
                run = {a + b for a in run for b in strings}
                continue
            query, exact = both(both(query, of_strings(run)), q), False
            run = {""} if strings is None else strings
        return (run, _ANY) if exact else (None, both(query, of_strings(run)))

    strings, query = walk(_parser.parse(regex))
    query = of_strings(strings) if strings is not None else query
    return _ANY if frozenset() in query else query


def selective(query: frozenset[Clause], most: int = 2) -> frozenset[Clause]:
    """The query with at most `most` trigrams a clause, the rarest letters first. It asks for less, so it misses nothing."""
    rank = lambda t: (-sum(_FREQUENT.find(c) % len(_FREQUENT) if c in _FREQUENT else len(_FREQUENT) for c in t), t)
    return frozenset(frozenset(sorted(c, key=rank)[:most]) for c in query)


def trigrams_of(low: Column, trigrams: list[str]) -> Column:
    """Those of the trigrams that occur in the lower-cased text."""
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]), lambda x: x.isNotNull())


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(row, kinds): for each row of the postings index(row, trigram) the rules of which at least one clause has all its trigrams, by
    intersecting the posting lists of each clause."""
    clauses = [(kind, f"{kind}:{k}", t, len(c)) for kind, q in queries.items() for k, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    wanted = index.sparkSession.createDataFrame(clauses, "kind string, clause string, trigram string, need int")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("row", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def steps(text: Column, found: Column, rule: Rule) -> Column:
    """Array of (gap, n, inner) of the matches `found`, in code points: the text before each, its length, and that of the rule's group."""
    inner = (lambda m: F.char_length(m)) if rule.group == 0 else (lambda m: F.char_length(F.regexp_extract(m, rule.regex, rule.group)))
    gaps = F.transform(F.slice(F.split(text, rule.regex, -1), 1, F.size(found)), lambda g: F.char_length(g))
    return F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.char_length(m).alias("n"), inner(m).alias("inner")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, secrets): for each row of docs the array of (kind, start, end) of all rules, by start, then in the rules' order.

    1. One pass over the texts writes, a row each, the trigrams of the rules that the text holds, what rules without mandatory trigrams
       find in it, and the text itself if it holds any of the trigrams.
    2. The postings (row, trigram) of the clauses are intersected. What is left meets its texts and is verified.
    3. Places are prefix sums of gaps and matches, over the matches of a row and rule.

    Null and empty texts hold nothing. Time and memory follow a text's length, however many matches it has; a very long text is read as a whole, and
    only its matches are dealt out. Rows are told apart by a number of their own, so repeated rows and ids are scanned one by one, and null ids
    don't matter. Matches that begin at one place are listed in the rules' order. An empty table gives an empty result. Other columns don't matter, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    queries = {r.kind: selective(trigram_query(r.regex)) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != _ANY}
    nothing = F.array().cast("array<struct<k:int,i:int,gap:int,n:int,inner:int>>")

    def matches(frame: DataFrame, keep: list[str], some: list[tuple[int, Rule]], reads) -> DataFrame:
        """keep, and matches: (k, i, gap, n, inner) of the rules that `reads` tells to read the text."""
        read = frame.select(*keep, "text", *[F.when(reads(r), F.regexp_extract_all("text", F.lit(r.regex), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m{k}") for k, r in some])
        numbered = lambda k, r: F.transform(steps(F.col("text"), F.col(f"m{k}"), r), lambda s, i: F.struct(F.lit(k).alias("k"), i.alias("i"), s["gap"].alias("gap"), s["n"].alias("n"), s["inner"].alias("inner")))
        return read.select(*keep, F.concat(nothing, *[numbered(k, r) for k, r in some]).alias("matches"))

    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    rows = docs.select(F.col(*quoted([id_col])).alias("id"), F.coalesce(F.col(*quoted([text_col])), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    held = trigrams_of(F.col("low"), trigrams) if trigrams else F.array().cast("array<string>")
    rows = rows.select("id", "text", held.alias("held"), F.monotonically_increasing_id().alias("row"))
    whole = matches(rows.withColumn("kept", F.when(F.size("held") > 0, F.col("text"))), ["row", "id", "held", "kept"], [(k, r) for k, r in enumerate(rules) if r.kind not in indexed], lambda r: F.lit(True))
    whole = scratch.write(whole)
    found = whole.select("row", F.explode("matches").alias("m"))
    if indexed:
        chosen = candidates(whole.select("row", F.explode("held").alias("trigram")), indexed)
        texts = whole.where("kept IS NOT NULL").select("row", F.col("kept").alias("text")).join(chosen, "row")
        more = matches(texts, ["row"], [(k, r) for k, r in enumerate(rules) if r.kind in indexed], lambda r: F.array_contains("kinds", r.kind))
        found = found.union(scratch.write(more).select("row", F.explode("matches").alias("m")))
    found = found.select("row", "m.*").withColumn("end", F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "k").orderBy("i")).cast("int"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("k") + 1)
    placed = found.where(F.col("inner") >= least).groupBy("row").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("n")).alias("start"), "k", "end"))).alias("all"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform("all", lambda s: F.struct(F.element_at(kinds, s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = whole.select("row", "id").join(placed, "row", "left").select(F.col("id").alias(id_col), F.coalesce(named, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("secrets"))
    out = scratch.write(out)
    scratch.close(out)
    return out


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns from secret_scan()'s output."""
    base = [r.kind for r in BASE]
    joined = lambda spans_: F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
