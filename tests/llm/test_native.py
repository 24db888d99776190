"""Secret scan, exact dedup, line dedup and mixing: brute force and edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netaudit.llm.common import components
from netaudit.llm.exact_dedup import exact_dedup
from netaudit.llm.line_dedup import host_of, line_dedup, lines_of
from netaudit.llm.mixing import mix, weights
from netaudit.llm.secret_scan import RULES, Rule, digest, secret_scan, trigram_query

DOCS = "doc_id long, text string, source string, id string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


SECRETS = [
    (1, "password = hunter22 and é AKIA" + "A" * 16 + " x " + "0" * 24, "a"), (2, None, "a"), (3, "", None), (4, "secret:token: abcdefgh", "a"), (5, "PASSWD=short TOKEN='longer_one'", "a"),
    (6, "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----", "b"), (7, "token=abc token=abcdefg 😀 api-key=1234567 api_key=1234567", "b"), (7, "pass word", "b"), (None, "token=abcdefgh", "b"), (8, "f" * 23 + " " + "f" * 30, "b"),
    (9, "x" * 50000 + " apikey : \"ABCDEFG\"", "c"), (10, "ſecret=abcdefgh toKen=abcdefgh", "c"),
]


def spans_by_hand(text):
    out = []
    for k, r in enumerate(RULES):
        for m in re.finditer(r.regex, text or "", re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end()))
    return [f"{RULES[k].kind}:{s}:{e}" for s, k, e in sorted(out)]


def test_secrets_by_hand(spark):
    got = Counter((r.doc_id, r.spans) for r in digest(secret_scan(docs(spark, SECRETS))).collect())
    assert got == Counter((i, ",".join(spans_by_hand(t))) for i, t, _ in SECRETS)
    assert digest(secret_scan(docs(spark, SECRETS[:0]))).count() == 0


def test_base_digest(spark):
    r = digest(secret_scan(docs(spark, SECRETS[:1]))).first()
    base = ",".join(x for x in spans_by_hand(SECRETS[0][1]))
    assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (1, 1, 1, hashlib.sha256(base.encode()).hexdigest())


@pytest.mark.parametrize(("regex", "query"), [("abcd", {frozenset({"abc", "bcd"})}), ("[0-9a-f]+", {frozenset()}), ("(abc|xyz)[0-9]+", {frozenset({"abc"}), frozenset({"xyz"})}), ("ab_?c", {frozenset({"abc"}), frozenset({"ab_", "b_c"})}), ("abc(x|y)*", {frozenset({"abc"})}), ("a?", {frozenset()})])
def test_trigram_queries(regex, query):
    assert trigram_query(regex) == query


def test_rules_of_ones_own(spark):
    found = secret_scan(docs(spark, [(1, "see ABCD99", "a")]), rules=(Rule("mine", "ABCD[0-9]+"),)).first().secrets
    assert [(s.kind, s.start, s.end) for s in found] == [("mine", 4, 10)]


def test_secrets_of_a_long_text_with_many_matches(spark):
    """10 MB with 100,000 matches: time in proportion to the text."""
    import time

    unit = "token=abcdefgh " + "x" * 85
    df = docs(spark, [(1, unit * 100_000, "a"), (2, "password: hunter22", "b"), (None, None, None)])
    secret_scan(docs(spark, SECRETS)).count()
    start = time.monotonic()
    got = {r.doc_id: r.secrets for r in secret_scan(df).collect()}
    assert time.monotonic() - start < 40
    assert [(s.start, s.end) for s in got[1]] == [(100 * k, 100 * k + 14) for k in range(100_000)]
    assert len(got[2]) == 1 and got[None] == []


def test_line_dedup_of_long_pages(spark):
    """Three pages of 100,000 dropped lines each."""
    import time

    lines = [f"line {k}" for k in range(100_000)]
    df = spark.createDataFrame([(k, "http://h.example", [*lines, f"own {k}"]) for k in range(3)], "page_id long, url string, l array<string>")
    line_dedup(df.limit(0), host_of(F.col("url")), F.col("l"), "page_id").count()
    start = time.monotonic()
    got = line_dedup(df, host_of(F.col("url")), F.col("l"), "page_id", 0.2, 3).collect()
    assert time.monotonic() - start < 40
    assert sorted((r.page_id, r.n_dropped, r.clean_text) for r in got) == [(k, 100_000, f"own {k}") for k in range(3)]


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    out = Counter()
    for i, t, _ in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out[(i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [2, 7, 16384])
def test_exact_dedup_by_hand(spark, block):
    long_ = "abc dé " * 30
    rows = [(1, "Abc", "a"), (2, "aBC", "a"), (3, None, "a"), (4, "", None), (5, long_, "b"), (6, long_.upper().replace("É", "é"), "b"), (7, long_ + "x", "b"), (8, long_[:-1] + "y", "b"), (5, long_, "b"), (5, "other", "b"), (None, "abc", "b"), (None, "lone", "b"), (9, "É", "c"), (10, "é", "c"), (11, "😀" * 9, "c"), (12, "😀" * 9, "c")]
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    out = exact_dedup(docs(spark, rows), block=block)
    assert Counter(tuple(r) for r in out.select(cols).collect()) == dedup_by_hand(rows)
    assert out.columns[:5] == ["doc_id", "text", "source", "id", "h"]


def test_exact_dedup_tells_hash_collisions_apart(spark, monkeypatch):
    rows = [(k, t, "a") for k, t in enumerate(["aa", "ab", "aa", "ba" * 5, "ba" * 5, "bb" * 5, ""])]
    real = F.xxhash64
    monkeypatch.setattr("netaudit.llm.exact_dedup.F.xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else real(*c))
    out = exact_dedup(docs(spark, rows), block=4)
    assert Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == dedup_by_hand(rows)


def test_exact_dedup_keeps_columns_of_any_name(spark):
    names = ["keep_id", "kept", "_kept", "group_size", "text_sha256", "_id", "_h", "_r1", "_copies", "r1", "r2", "bh", "name", "_hot", "_salt"]
    rows = [(k % 7, t, *[f"{c}{k}" for c in names]) for k, t in enumerate(["a", "A", "b", None, "", "a"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = exact_dedup(df)
    assert Counter(tuple(r)[: len(rows[0])] for r in out.collect()) == Counter(rows)
    assert out.columns == df.columns + ["_keep_id", "_group_size", "__kept", "_text_sha256"]
    assert Counter((r.doc_id, r._keep_id, r._group_size, r["__kept"], r._text_sha256) for r in out.collect()) == dedup_by_hand([(r[0], r[1], None) for r in rows])


def test_block_names_don_t_depend_on_partitions(spark):
    from netaudit.llm.common import Scratch
    from netaudit.llm.exact_dedup import block_names

    rows = [(k, "xy" * (k % 9) + "z" * (k % 5), "a") for k in range(60)]
    got = [{r.id: (r.n_blocks, r.name) for r in block_names(Scratch(spark), docs(spark, rows).repartition(n), "doc_id", "text", 3).collect()} for n in (1, 5)]
    assert got[0] == got[1] and min(name for n, name in got[0].values() if n == 1) == 0


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_line_dedup_by_hand(spark):
    pages = [(k, f"http://h.example/{k}", ["nav", f"own {k}", "twice", "twice"] if k % 2 else ["nav", f"own {k}"]) for k in range(10)] + [(20, "http://u@other.example:80/x", ["nav"]), (20, None, ["nav"]), (None, "https://H.example", None), (21, "http://h.example", [])]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, l array<string>, host string")
    got = Counter((r.page_id, r.host, r.n_lines, r.n_dropped, r.clean_text) for r in line_dedup(df, host_of(F.col("url")), F.col("l"), "page_id", 0.2, 3).collect())
    want = Counter()
    for i, u, lines in pages:
        host = "" if u is None else "other.example" if "other" in u else "h.example"
        kept = [x for x in lines or [] if not (host == "h.example" and x in ("nav", "twice"))]
        want[(i, host, len(lines or []), len(lines or []) - len(kept), "\n".join(kept))] += 1
    assert got == want
    assert line_dedup(df.limit(0), host_of(F.col("url")), F.col("l"), "page_id").count() == 0


def test_lines_of_a_page(spark):
    html = "<head><title>T</title><script>if (a<b) {}</script></head><!-- <p>no</p> --><p>one <b>two</b>\n three</p><li>x<br>y</li>"
    assert spark.createDataFrame([(html,)], "h string").select(lines_of(F.col("h"))).first()[0] == ["T", "one two three", "x", "y"]
    assert spark.createDataFrame([(None,)], "h string").select(lines_of(F.col("h"))).first()[0] == []


def test_weights(spark):
    w = {r.source: r for r in weights(spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")).collect()}
    assert abs(sum(r.weight for r in w.values()) - 1) < 1e-9 and w["a"].epochs == 1.0 and abs(w["c"].epochs - 2.0) < 0.06
    flat = weights(spark.createDataFrame([("a", 1000), ("b", 10)], "source string, tokens long"), repeats=None, entropy=0.5).collect()
    from math import log

    assert abs(-sum(r.weight * log(r.weight) for r in flat) - 0.5) < 1e-6


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_mix_reads_every_row_within_budget(spark, block):
    rows = [(k, "w " * (k % 7 + 1), "big" if k % 3 else None) for k in range(200)] + [(500, None, "small"), (501, "", "small"), (501, "", "small"), (None, "a b", "small")]
    out = mix(docs(spark, rows), block_tokens=block).collect()
    n = Counter((r.doc_id, r.text) for r in out)
    assert set(n) == {(i, t) for i, t, _ in rows} and max(n.values()) <= 4
    for source in ("big", None, "small"):
        mine = sorted((r.mix_start, r.mix_tokens) for r in out if r.source == source)
        assert mine[0][0] == 0
        starts = sorted(set(mine))
        assert all(a + t <= b for (a, t), (b, _) in zip(starts[:-1], starts[1:], strict=True))
    first = [r.doc_id for r in sorted(out, key=lambda r: r.mix_start) if r.source == "big" and r.mix_pass == 0]
    assert first != sorted(first) and mix(docs(spark, [])).count() == 0


def test_mix_by_hand(spark):
    """Row by row: each source's stream from the operator's places, against the budget that a plain bisection gives."""
    rows = [(k, "w " * (k % 5 + 1), "big") for k in range(300)] + [(k, "a b c", "mid") for k in range(400, 430)] + [(k, "x", None) for k in range(500, 510)]
    out = mix(docs(spark, rows), block_tokens=40).collect()
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len(t.split())
    low, high, whole = 0.0, 1.0, sum(totals.values())
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if (max(totals.values()) / min(totals.values())) ** (1 - mid) > 2.0 else (low, mid)
    z = sum((n / whole) ** high for n in totals.values())
    weight = {s: (n / whole) ** high / z for s, n in totals.items()}
    budget = {s: max(totals[s], round(weight[s] * max(totals[x] / weight[x] for x in totals))) for s in totals}
    for s in totals:
        mine = sorted((r.mix_start, r.mix_tokens, r.mix_pass, r.doc_id) for r in out if r.source == s)
        at = 0
        for start, n, k, _ in mine:
            assert start == at and k == at // totals[s]
            at += n
        assert budget[s] <= at < budget[s] + 5
        full = Counter(i for _, _, k, i in mine if k == 0)
        assert full == Counter(i for i, _, x in rows if x == s)
    one = [r.doc_id for r in sorted(out, key=lambda r: r.mix_start) if r.source == "mid" and r.mix_pass == 0]
    assert one != sorted(one)
    clash = docs(spark, rows[:3]).selectExpr("*", "'a' AS _k", "'b' AS _reads", "'c' AS mix_pass")
    got = mix(clash).collect()
    assert [r.mix_pass for r in got][:1] == ["c"] and {r._mix_pass for r in got} == {0} and {r._k for r in got} == {"a"}


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(20)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
