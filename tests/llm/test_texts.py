"""HTML, language, quality, n-gram join, quality rules and packing: brute force, round trips and edge cases."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netaudit.llm import language_id, ngram_join, quality
from netaudit.llm.html_text import html_text, parse, render
from netaudit.llm.ngram_join import keys_of, ngram_components
from netaudit.llm.packing import Encoder, pack
from netaudit.llm.quality_rules import counts, quality_rules
from netaudit.llm.words import shingles, word_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)


def test_rendering():
    page = """<html><head><title>t</title><style>p{}</style></head><body hidden-x><nav><ul><li>a<li>b<ul><li>c</ul></ul></nav>
    <p>one <b>two</b>
    three<p>four<br>five<div style="display: none">no</div><span hidden>no</span><script>"</p>"</script>
    <ol start=3><li>x<li>y</ol><table><tr><th>k<th>value<tr><td>long one<td>1</table><pre>a
  b</pre>&amp;&copy;<!-- no --></body></html>"""
    assert render(parse(page)).split("\n") == ["- a", "- b", "  - c", "", "one two three", "", "four", "five", "", "3. x", "4. y", "", "k        | value", "long one | 1", "", "a", "  b", "", "&©"]


@pytest.mark.parametrize("page", ["", "<", "<p", "</div></p>", "<table><td>x", "<div>" * 3000 + "deep", "a<b>c", "<!-- open", "<script>open", "<li>x", "&bad; <p>&#x41;"])
def test_broken_markup(page):
    render(parse(page))


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a | b"), ("<table><tr><div>lost</div><td>x</td></tr></table>", "lost\nx"), ('<a href="foo>link</a> more', "link more"),
    ("<table><tr><td>p<p>q<br>r</td><td>z</td></tr><tr><td colspan=2>wide</td></tr></table>", "p | z\n  |\nq |\nr |\nwide"), ("<table><tr><td>1<td><table><tr><td>in<td>ner</table></table>", "1 | in | ner"),
    ("<textarea>x\n y</textarea><select><option>o1<option>o2</select><svg><title>no</title><text>svg</text></svg>", "x\n y\no1\no2\nsvg"), ("<div aria-hidden=true>aria</div>", "aria"), ("<head><title>t</title>plain text", "plain text"),
    ("<table><caption>cap</caption><tr><td rowspan=2>r<td>1<tr><td>2</table>after", "cap\nr | 1\n  | 2\n\nafter"), ("<style>.x, b.y{display:none} i{display:none}</style><p class='q x'>no</p><b class=y>no</b><u class=y>yes</u><i>no</i>", "yes"),
    ('<span style="display:block">a</span><span style="display:block">b</span><p style="display:inline">c</p><p style="display: inline">d</p>', "a\nb\ncd"), ("<!--><p>x</p><!--->y<!-- z -->", "x\n\ny"),
    ("<input type=submit value=Go><input type=reset><input type=text value=no><input type=button value='Push me'>", "GoResetPush me"), ("<details>no<summary>sum</summary>no</details><details open><summary>a</summary>b</details>", "sum\na\nb"),
    ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"), ("<table><tfoot><tr><td>foot</tfoot><tbody><tr><td>body</table>", "body\nfoot"), ("<style>.x{display:block}</style><b class=x>a</b><b class=x>b</b>", "a\nb"),
    ("<style>@media print{.z{display:none}} #a{visibility:hidden}</style><p class=z>yes</p><div id=a>no <span style='visibility:visible'>seen</span></div>", "yes\n\nseen"), ("x <!-- y > z", "x"), ("<p style='display:none'>no</p><dialog>no</dialog><dialog open>yes</dialog>", "yes"),
])
def test_visible_text(page, text):
    assert render(parse(page)) == text


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>x</i>" * 100_000, "<table><tr><td>a<td>" * 20_000, '<a ">"' * 150_000, "<table>" + "<b>" * 80_000 + "<p>x</p>" * 60_000, "<!--" * 250_000, "<style>" + "a b c " * 150_000, "<ul><li>x" * 50_000, "<table><tr>" + "<td>x" * 100_000, "<table>" + "<tr><td rowspan=100 colspan=100>x" * 20_000], ids=range(10))
def test_hostile_pages_take_time_in_proportion(page):
    import time

    start = time.monotonic()
    render(parse(page))
    assert time.monotonic() - start < 20


def test_all_visible_words_come_out_in_order():
    rng = random.Random(11)
    for _ in range(40):
        shown = []

        def tree(depth, visible):
            parts = []
            for _ in range(rng.randint(1, 4)):
                kind = rng.choice(["word", "word", "b", "div", "p", "ul", "table", "hide", "span"] if depth < 5 else ["word"])
                if kind == "word":
                    w = f"w{rng.randrange(10**6)}"
                    parts.append(f" {w} ")
                    shown.extend([w] if visible else [])
                elif kind == "hide":
                    parts.append(rng.choice(["<div hidden>", "<div style='display:none'>", "<div class=h>"]) + tree(depth + 1, False) + "</div>")
                elif kind == "ul":
                    parts.append("<ul>" + "".join(f"<li>{tree(depth + 1, visible)}</li>" for _ in range(2)) + "</ul>")
                elif kind == "table":
                    parts.append(f"<table><tr><td>{tree(depth + 2, visible)}</td></tr><tr><td>{tree(depth + 2, visible)}</td></tr></table>")
                else:
                    parts.append(f"<{kind}>{tree(depth + 1, visible)}</{kind}>" if kind != "p" else f"<div><p>{tree(9, visible)}</p></div>")
            return "".join(parts)

        page = "<style>.h{display:none}</style>" + tree(0, True)
        assert re.findall(r"w\d+", render(parse(page))) == shown


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (1, "<p>x</p><p>y")], "page_id long, html string")
    assert Counter(tuple(r) for r in html_text(df, ["page_id"]).collect()) == Counter([(1, ""), (2, ""), (None, "x"), (1, "x\n\ny")])
    assert html_text(df.limit(0), ["page_id"]).count() == 0
    clash = df.selectExpr("page_id", "html", "'c' AS visible_text", "'r' AS row")
    assert html_text(clash, clash.columns).columns == ["page_id", "html", "visible_text", "row", "_visible_text"]


def test_language(spark):
    rng = random.Random(1)
    parts = {"aa": ["th", "er", "on", "and"], "bb": ["ung", "sch", "ich", "der"], "cc": ["é", "eux", "qui", "ment"]}
    make = lambda x, n=40: " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(n))
    rows = spark.createDataFrame([(make(x), x) for x in parts for _ in range(40)] + [(None, "aa"), (make("aa"), None)], "text string, lang string")
    model = language_id.learn(rows)
    assert model.langs == ("aa", "bb", "cc")
    tests = [(k, make(x), x) for k, x in enumerate(list(parts) * 20)] + [(100, None, "und"), (101, "", "und"), (102, "123 ### 😀", "und")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(tests, "doc_id long, text string, lang_pred string").drop("lang_pred"), model, ["doc_id"]).collect()}
    assert all(got[k].lang_pred == x for k, _, x in tests) and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.identify(docs(spark, tests and [(1, make("bb")), (1, make("bb"))]), model, ["doc_id", "text", "node", "n"])
    assert kept.columns == ["doc_id", "text", "node", "n", "lang_pred", "score"] and kept.count() == 2
    names = ["letters", "score", "lang_pred", "_", "row"]
    clash = docs(spark, [(1, make("bb")), (2, None)]).selectExpr("doc_id", "text", *[f"'{c}' AS {c}" for c in names])
    kept = language_id.identify(clash, model, clash.columns).collect()
    assert [list(r)[2:7] for r in kept] == [names] * 2 and {r._lang_pred for r in kept} == {"bb", "und"}
    assert language_id.identify(clash.limit(0), model, clash.columns).count() == 0
    empty = language_id.learn(rows.limit(0))
    assert language_id.identify(docs(spark, [(1, "abc")]), empty, ["doc_id"]).first().lang_pred == "und"


def test_language_filter_holds_all_it_learned(spark):
    rows = spark.createDataFrame([("abcdef ghi", "x"), ("abcdef ghi", "x"), ("zzz yyy", "y"), ("zzz yyy", "y")], "text string, lang string")
    m = language_id.learn(rows)
    for k, t in enumerate(["abcdef ghi", "zzz yyy"]):
        h, _ = language_id.grams(pa.array([t]))
        held = np.full(len(h), 255, m.masks.dtype)
        for at in language_id._places(h):
            held &= m.masks[0][at]
        assert (held >> k & 1).all()


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["the", "and", "reed", "lion", "tree", "stone"], k=30))
    bad = lambda: " ".join(w + rng.choice(["###", "%%%"]) for w in rng.choices(["the", "and", "reed", "lion"], k=30))
    rows = [(k, good() if k % 4 else bad()) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(200)] + [(None, 1), (5, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.learn(docs(spark, rows), labels)
    got = quality.score(docs(spark, [*rows, (1000, None), (1001, ""), (1001, "")]), model, ["doc_id"]).collect()
    held = [(r.score, r.doc_id % 4 > 0) for r in got if 200 <= r.doc_id < 1000]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y) and len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert quality.learn(docs(spark, rows), labels.limit(0)) is None
    assert quality.score(docs(spark, rows[:1]), None, ["doc_id"]).first().score == 0.5
    clash = docs(spark, rows[:1]).withColumn("score", F.lit("s")).withColumn("label", F.lit("l"))
    assert quality.score(clash, model, clash.columns).columns == [*clash.columns, "_score"] and quality.score(clash.limit(0), model, ["doc_id"]).count() == 0
    assert quality.learn(docs(spark, []), labels) is None


def test_language_against_sets(spark):
    """The filter's answers are those of plain sets of n-grams, up to its false positives."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").select("doc_id", "text", "lang").collect()
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    model = language_id.learn(df)
    sizes, times = Counter(r.lang for r in rows if r.lang), {}
    for r in rows:
        if r.lang:
            for g in set(language_id.grams(pa.array([r.text]))[0].tolist()):
                times.setdefault(g, Counter())[r.lang] += 1
    held = {}
    for g, c in times.items():
        rate = {x: n / sizes[x] for x, n in c.items() if n >= 2}
        held[g] = {x for x, v in rate.items() if v >= language_id.SHARE * max(rate.values())}
    for r in language_id.identify(df, model, ["doc_id", "text"]).collect():
        own = language_id.grams(pa.array([r.text]))[0].tolist()
        share = {x: sum(x in held.get(g, ()) for g in own) / len(own) for x in model.langs}
        if any(ch.isalpha() for ch in r.text):
            assert share[r.lang_pred] >= max(share.values()) - 0.02 and abs(r.score - share[r.lang_pred]) < 0.02


def test_dual_descent_against_a_dense_one():
    """The hinge loss's dual on dense vectors, by many plain sweeps, gives the same margins' signs and nearly the same weights."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for k in range(100):
        y = int(rng.random() < 0.5)
        texts.append(" ".join(rng.choice(["red", "stone", "water", "up", "old"] if y else ["spam", "stone", "water", "buy", "now"], 12)))
        labels.append(y)
    labels = np.array(labels)
    offsets, found = quality.features(pa.array(texts))
    m = quality.fit(offsets, found, labels)
    tune = np.arange(100) % 5 == 4
    x = np.zeros((100, 1 << quality.BITS))
    for k in range(100):
        x[k, found[offsets[k] : offsets[k + 1]]] = 1
    p, q = (1 + x[~tune & (labels == s)].sum(axis=0) for s in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = x * ratio / np.linalg.norm(x * ratio, axis=1, keepdims=True)
    y = np.where(labels == 1, 1.0, -1.0)
    rows, alpha, z = np.flatnonzero(~tune), np.zeros(100), np.hstack([x, np.ones((100, 1))])
    cost = np.where(y > 0, quality.COST * max(1, (y < 0).sum()) / max(1, (y > 0).sum()), quality.COST)
    w = np.zeros(z.shape[1])
    for _ in range(200):
        for i in rows:
            new = np.clip(alpha[i] - (y[i] * (z[i] @ w) - 1) / (z[i] @ z[i]), 0, cost[i])
            w += (new - alpha[i]) * y[i] * z[i]
            alpha[i] = new
    mine = np.array([(m.weights[0][found[a:b]].sum()) / np.sqrt(m.weights[1][found[a:b]].sum()) + m.bias for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    assert np.corrcoef(mine, z @ w)[0, 1] > 0.999 and ((mine > 0) == (z @ w > 0)).mean() > 0.98


def shingle_set(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def by_hand(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(rng, groups, size):
    vocabulary = [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=size)
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(("n", "percent", "size"), [(3, 90, 120), (5, 80, 80), (3, 90, 12), (1, 75, 20)])
def test_join_by_hand(spark, n, percent, size):
    rows = corpus(random.Random(size), 12, size) + [(900, None), (901, ""), (902, " \t"), (903, "Ab"), (904, "aB"), (905, "É é"), (None, "ab"), (906, "a b c"), (906, "a b c"), (906, "q r s t u")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs(spark, rows), n, percent).collect())
    assert got == by_hand(rows, n, percent)


@pytest.mark.parametrize("rare", [0, 3, 10**9])
def test_join_of_crowds(spark, monkeypatch, rare):
    """All tokens frequent, few, none; small blocks, crowds and hot keys."""
    for name, value in {"_CHUNK": 8, "RARE": rare, "CROWD": 2, "_HOT": 4, "_HELD": 500, "SEEDS": (1,)}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"w{rng.randrange(60)}"
        rows.append((k, " ".join(t + [f"u{j}" for j in range(k % 9)])))
    rows += [(k, " ".join(base[:30] + [f"v{k}x{j}" for j in range(8)])) for k in range(200, 240)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs(spark, rows), 3, 80).collect())
    assert got == by_hand(rows, 3, 80)


def test_hot_keys_are_salted_and_still_meet_others():
    keys, tags = np.array([7] * 100 + [8] * 3, np.uint64), np.arange(103, dtype=np.uint64)
    got = [b.to_pydict() for b in ngram_join._salted(keys, tags)]
    rows = [(k, t, s) for b in got for k, t, s in zip(b["key"], b["h1"], b["salt"], strict=True)]
    assert {(k, t) for k, t, _ in rows} == set(zip(keys.tolist(), tags.tolist(), strict=True))
    assert len({s for k, _, s in rows if k == 7}) > 20 and sum(k == 7 and s == 0 for k, _, s in rows) == 2 and [s for k, _, s in rows if k == 8] == [0, 0, 0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_pairs_of_frequent_tokens_carry_part_of_the_index(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sets = [s for s in shingles(*word_hashes(pa.array(texts)), 3) if len(s) >= 9]
    counts = np.zeros(1 << ngram_join._BITS, np.int64)
    np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - ngram_join._BITS)).astype(np.int64), 1)
    found = [keys_of(s, counts, 90) for s in sets]
    singles, pairs = Counter(np.concatenate([f[0] for f in found]).tolist()), Counter(np.concatenate([f[1] for f in found]).tolist())
    assert len(pairs) > 100 and sum(n > 1 for n in pairs.values()) > 50 and len(singles) > 1000


def test_join_with_clashing_columns(spark):
    rows = corpus(random.Random(3), 4, 60)
    names = ["key", "row", "h1", "h2", "comp", "m", "salt", "blk", "n_shingles", "component_id", "component", "size"]
    df = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    got = ngram_components(df, 3, 90)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == by_hand(rows, 3, 90) and got.schema["doc_id"].dataType.simpleString() == "int"


def test_join_of_nothing(spark):
    assert ngram_components(docs(spark, []), 3, 90).count() == 0
    assert ngram_components(docs(spark, [(1, None)]), 3, 90).first().component_id == 1


@pytest.mark.parametrize("percent", [75, 80, 90, 99])
def test_linked_sets_share_a_key(percent):
    """Random linked sets, as unlike as they may be, share a key, whichever of their tokens are rare."""
    rng = np.random.default_rng(percent)
    for _ in range(600):
        size, seed = int(rng.integers(-(-percent // (100 - percent)), 200)), rng.integers(2**63)
        base = np.unique(np.random.default_rng(seed).integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        a, b, extra = base[rng.permutation(len(base))[:size]], None, list(base[rng.permutation(len(base))])
        b = list(a)
        while True:
            c = [x for k, x in enumerate(b) if k != rng.integers(len(b))] if rng.random() < 0.5 else [*b, extra.pop()]
            c = list(dict.fromkeys(c))
            s = len(set(a.tolist()) & {int(x) for x in c})
            if 100 * s < percent * (len(a) + len(c) - s) or not extra:
                break
            b = c
        counts = rng.integers(2, 8, 1 << ngram_join._BITS)
        one, two = (np.concatenate(keys_of(np.unique(np.array(x, np.uint64)), counts, percent)) for x in (a, b))
        assert len(np.intersect1d(one, two))


def test_hashes_don_t_depend_on_neighbours():
    texts = ["One two  three", None, "", "x", "one TWO three four"]
    together = list(shingles(*word_hashes(pa.array(texts)), 2))
    alone = [next(shingles(*word_hashes(pa.array([t], pa.string())), 2)) for t in texts]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(together, alone, strict=True)) and [len(x) for x in together] == [2, 0, 0, 1, 3]
    long_ = "y" * 9000
    a, b = (next(shingles(*word_hashes(pa.array([t])), 1))[0] for t in (long_ + "a", long_ + "b"))
    assert a != b


def repeats_by_hand(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    c, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if c[w] > 1:
            hit.update(range(k, k + 5))
    return len(hit)


def test_quality_counts():
    rng = random.Random(3)
    for _ in range(50):
        t = " ".join(rng.choices("abc", k=rng.randint(0, 60))).replace("a b", "a\nb")
        assert counts(t)[4] == repeats_by_hand(WORD.findall(t))
    assert counts("a#b <c>\n\n a#b <c>\nx\n a#b <c>") == (7, 19, 9, 1, 0)
    assert counts("") == (0, 0, 0, 0, 0)


def test_quality_rules_keep_prose_and_reject_noise(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rng.randint(1, 4))) for _ in range(800))
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=60)) for _ in range(100))
    loop = " ".join(f"{'ab' * 30}{k}" for k in range(300))
    got = {r.doc_id: r for r in quality_rules(docs(spark, [(1, prose), (2, noise), (3, loop), (4, None), (5, "few words"), (6, prose + " " + prose)]), ["doc_id"]).collect()}
    assert [got[k].kept for k in range(1, 7)] == [True, False, False, False, False, False] and got[6].base_failed and not got[3].base_failed
    assert quality_rules(docs(spark, []), ["doc_id"]).count() == 0
    clash = docs(spark, [(1, prose)] * 2).withColumn("kept", F.lit("k")).withColumn("row", F.lit("r"))
    assert [(r.kept, r._kept) for r in quality_rules(clash, clash.columns).collect()] == [("k", True)] * 2


def test_bands_by_hand(spark):
    import zstandard

    from netaudit.llm.quality_rules import BANDS, CHUNK_BAND

    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(-k, "ab" * k) for k in range(1, 3000, 97)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows), ["doc_id"]).collect()}
    for i, t in rows:
        data = t.encode()
        ends = sorted({*range(4096, len(data) + 1, 4096), len(data)}) if len(data) > 4096 else []
        out = [not CHUNK_BAND[0] <= 4096 / size(data[e - 4096 : e]) <= CHUNK_BAND[1] for e in ends]
        whole = len(data) / size(data) if data else 1.0
        low, high = [(a, b) for least, a, b in BANDS if least <= len(data)][-1]
        words = WORD.findall(t)
        fine = len(words) >= 10 and 100 * repeats_by_hand(words) <= 20 * len(words)
        assert got[i].kept == (fine and (not data or (low <= whole <= high and sum(out) < 0.5 * max(1, len(out))))), i


TRICKY = ["", None, "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "don't stop's", "é è 日本語 テスト", "x <|endoftext|> y", "12 345,678", "\t\ttab", "nbsp  here", "a b c", "word " * 50, "😀 😀", "z\0 y\0z", "#$% ^&* ()"]


def test_encoder_matches_the_tokenizer():
    e = Encoder(BPE)
    texts = [t or "" for t in TRICKY] * 2
    assert e.encode(texts) == [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choices(["a", "B", " ", "  ", "\n", "é", "1", ".", "'s", " ", "word", "##"], k=rng.randint(1, 20)))
        assert e.encode([t])[0] == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing_round_trip(spark):
    rows = list(enumerate(TRICKY)) + [(50, "long words here " * 400), (50, "again"), (None, "no id")]
    out = pack(docs(spark, rows), BPE, length=64).collect()
    e = Encoder(BPE)
    ids = Counter()
    for i, t in rows:
        ids[(i, len(e.ids(t or "")) + 1)] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == ids
    whole = {i: np.append(e.ids(t or ""), 1).astype("<u4") for i, t in rows if i != 50}
    assert all(zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in out if r.doc_id in whole)
    at = 0
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert divmod(at, 64) == (r.sequence_id, r.offset) and r.offset + r.length <= 64
        at += r.length
    assert at == sum((n * c for (_, n), c in ids.items()))
    assert pack(docs(spark, []), BPE).count() == 0
