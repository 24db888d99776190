"""Sharding, alignment and spelling variants: exact draws, brute force over small fixtures, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from netaudit.llm import queries
from netaudit.llm.alignment import Tokens, align, align_ends, gallop
from netaudit.llm.common import Scratch
from netaudit.llm.sharding import communication_matrix, digest, hypergeometric, shard
from netaudit.llm.spelling import near_pairs, spelling_variants

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "doc_id long, text string, shard int, slot int, at int, row int, word string, n int, pair int, `a.b` int"
SMALL = "/root/testdata/sf0.001"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "w", 5, 6, 7) for i, t in rows], ODD)


# sharding


def _drawn(good, bad, n, u):
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, int((n + 1) * (good + 1) / (good + bad + 2))))
    left = Fraction(u)
    for k in [mode, *range(mode + 1, high + 1), *range(mode - 1, low - 1, -1)]:
        left -= Fraction(comb(good, k) * comb(bad, n - k), comb(good + bad, n))
        if left < 0:
            return k
    raise AssertionError


def test_hypergeometric_draws_are_exact(spark):
    cases = [(g, b, n, k / 23) for g in range(6) for b in range(6) for n in range(g + b + 1) for k in range(23)]
    got = spark.createDataFrame(cases, "g long, b long, n long, u double").withColumn("x", F.expr(hypergeometric("u", "g", "b", "n"))).collect()
    assert [r.x for r in got] == [_drawn(r.g, r.b, r.n, r.u) for r in got]


def test_large_draws_stay_near_the_mean(spark):
    rows = [(10**9, 3 * 10**9, 10**8, k / 100) for k in range(1, 100, 7)] + [(5, 10**11, 10**9, 0.5), (10**11, 5, 10**9, 0.5)]
    got = spark.createDataFrame(rows, "g long, b long, n long, u double").withColumn("x", F.expr(hypergeometric("u", "g", "b", "n"))).collect()
    for r in got:
        mean = r.n * r.g / (r.g + r.b)
        assert abs(r.x - mean) < 5 * (mean * r.b / (r.g + r.b)) ** 0.5 + 2


def test_matrix_has_exact_margins(spark):
    counts = {0: 7, 3: 0, 4: 1, 9: 40, 10: 13, 11: 2, 12: 5}
    rows = communication_matrix(spark.createDataFrame(list(counts.items()), "part long, n long"), 5, 1).collect()
    cells = {r.part: r.cells for r in rows}
    assert {p: sum(c) for p, c in cells.items()} == counts
    assert [sum(c[s] for c in cells.values()) for s in range(5)] == [14, 14, 14, 13, 13]


def test_matrix_follows_its_law(spark):
    """Two partitions of 3 and 2 rows, two shards of 3 and 2 places: the first cell is hypergeometric."""
    counts = spark.createDataFrame([(0, 3), (1, 2)], "part long, n long")
    seen = Counter()
    got = None
    for seed in range(60):
        m = communication_matrix(counts, 2, seed).where("part = 0").select(F.col("cells")[0].alias("x"))
        got = m if got is None else got.union(m)
    seen = Counter(r.x for r in got.collect())
    assert set(seen) <= {1, 2, 3}
    assert abs(seen[2] / 60 - 6 / 10) < 0.25 and abs(seen[1] / 60 - 3 / 10) < 0.25


def test_shards_are_exact_and_whole(spark):
    rows = [(k % 90, None if k % 7 == 0 else "x" * (k % 50)) for k in range(101)] + [(None, "long " * 200_000), (5, ""), (5, "")]
    docs = odd(spark, rows).repartition(7)
    out = shard(docs, 6).cache()
    assert out.columns == [*docs.columns, "_shard", "_slot"]
    got = out.groupBy("_shard").agg(F.count("*").alias("n"), F.min("_slot").alias("a"), F.max("_slot").alias("b"), F.countDistinct("_slot").alias("d")).orderBy("_shard").collect()
    assert [tuple(r) for r in got] == [(s, n, 0, n - 1, n) for s, n in enumerate([18, 18, 17, 17, 17, 17])]
    assert Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == Counter(rows)
    assert shard(docs.limit(0), 6).count() == 0
    assert sorted(r._shard for r in shard(docs.limit(3), 6).select("_shard").collect()) == [0, 1, 2]


def test_every_place_is_as_likely(spark):
    """Over many seeds each of 4 rows of 2 partitions stands in each of 4 places about equally often."""
    docs = spark.range(4).selectExpr("id doc_id", "cast(id as string) text").repartition(2, "doc_id").cache()
    seen, times = Counter(), 24
    for seed in range(times):
        seen.update((r.doc_id, 2 * r.shard + r.slot) for r in shard(docs, 2, seed).select("doc_id", "shard", "slot").collect())
    chi = sum((seen[d, p] - times / 4) ** 2 / (times / 4) for d in range(4) for p in range(4))
    assert chi < 30  # 9 degrees of freedom, p < 0.0005


def test_sharding_query(spark):
    out = queries.op11_sharding(spark, SMALL).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(docs) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s])) for s in sizes)
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    assert digest(shard(spark.createDataFrame([(1, None)], "doc_id long, text string"))).first()[1:3] == (8, 0)


# alignment


def _plain(texts):
    """What align is about, text by text and pair by pair."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    rows, docs_of = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        pa_ = [bytes(byte[c] for c in a_model.id_to_token(k)) for k in a]
        pb = [bytes([k - 3]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(pa_) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            rows.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in pa_]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        common, groups, i, j = sorted(set(ea) & set(eb)), [], 0, 0
        for end in common:
            m, n = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if max(ea[x] - len(pa_[x]), eb[y] - len(pb[y])) < min(ea[x], eb[y])]
        docs_of.update(set(links))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = Counter()
    for (x, _), n in docs_of.items():
        top[x] = max(top[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(docs_of[p] == top[p[0]] for p in r[3]), sum(docs_of[p] for p in r[3]), r[4]) for r in rows]


def test_gallop():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        m = int(rng.integers(1, 80))
        a, b = (np.flatnonzero(rng.random(m) < rng.random()) + 1 for _ in "ab")
        short, long = sorted((a, b), key=len)
        assert (gallop(short, long) == np.searchsorted(long, short)).all()
    assert gallop(np.arange(1000, 1003), np.arange(5000)).tolist() == [1000, 1001, 1002]


def test_overlaps():
    rng = np.random.default_rng(4)
    for _ in range(1000):
        m = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(np.flatnonzero(rng.random(m) < rng.random()) + 1, m)) for _ in "ab")
        a_cuts, b_cuts, i, j = align_ends(a, b)
        assert a[a_cuts - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist())) == b[b_cuts - 1].tolist()
        from_a, from_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if max(from_a[x], from_b[y]) < min(a[x], b[y])]


TEXTS = [
    "The quick brown fox, the quick brown fox.", "", None, "a", " lead", "trail ", "two  blanks", "tab\there\nline", "x▁y", "größer naïve Café", "<|endoftext|> is text <s>", "日本語のテキスト", "🙂🙂 emoji", "12345 67,890.12", "\x00nul", "the the the the", "   ", "é combining", "ﬁne", "http://a.b/c?d=e&f",
]


def test_align_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(5, "The quick brown fox, the quick brown fox."), (None, "the repeated row"), (None, "the repeated row")]
    want = sorted(zip([i if i is not None else -1 for i, _ in rows], _plain([t or "" for _, t in rows]), strict=True))
    docs = odd(spark, rows).repartition(4)
    for sizes in ({}, {"slice_pairs": 7, "part_bytes": 200}):
        got = align(docs, A, B, **sizes).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in got) == want
    assert align(docs.limit(0), A, B).count() == 0
    assert align(docs.where("text IS NULL"), A, B).first().groups == ""


def test_long_text_aligns_like_its_tokens():
    tokens = Tokens(A, B)
    text = "unbroken" * 5_000 + " " + "word, and more " * 20_000 + "end"
    a, b = tokens.encode([text])[0]
    whole = tokens._whole(" " + text)
    assert (a == whole[0]).all() and (b == whole[1]).all()
    a_cuts, b_cuts, i, _ = align_ends(np.cumsum(tokens.a_sizes[a]), np.cumsum(tokens.b_sizes[b]))
    assert len(i) == len(a) + len(b) - len(a_cuts) and a_cuts[-1] == len(a) and b_cuts[-1] == len(b)


def test_alignment_query(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    short = spark.createDataFrame([(i, t) for i, t in docs if len(t) < 1500], "doc_id long, text string")
    want = dict(zip([r.doc_id for r in short.collect()], _plain([r.text for r in short.collect()]), strict=True))
    got = align(short, A, B, digest=True).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got} == {i: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in want.items()}
    whole = queries.op12_alignment(spark, SMALL)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.count() == len(docs)


# spelling


def _edits(words):
    """Pairs one edit apart, by words with one code point left out."""
    under = {}
    for w in words:
        for i in range(len(w)):
            under.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    found = {frozenset((u, v)) for group in under.values() for u in group for v in group if u != v}
    all_words = set(words)
    return found | {frozenset((w, w[:i] + w[i + 1 :])) for w in words for i in range(len(w)) if w[:i] + w[i + 1 :] in all_words}


def _variants(rows, length=7, often=2, times=10, noise=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if noise and h % noise == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= often}
    near = {w: [] for w in n}
    for pair in _edits(n):
        u, v = pair
        near[u].append(v)
        near[v].append(u)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_near_pairs_brute_force(spark):
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("ab" if rnd.random() < 0.9 else "cé") for _ in range(rnd.randint(1, 10))) for _ in range(700)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for pairs in (1, 4, 256):  # splits down to one code point, some, none
        got = [frozenset((r.word, r.other)) for r in near_pairs(frame, Scratch(spark), pairs).collect()]
        assert len(got) == len(set(got)) and set(got) == _edits(words)


def test_variants_brute_force(spark):
    rnd = random.Random(6)
    base = ["international", "Übersetzung", "wonderful", "résumées", "aaaaaaaa", "seventh"]
    rows = []
    for k in range(300):
        words = []
        for _ in range(30):
            w = rnd.choice(base)
            if rnd.random() < 0.08:
                i = rnd.randrange(len(w))
                w = rnd.choice((w[:i] + w[i + 1 :], w[:i] + rnd.choice("xyé") + w[i:], w[:i] + rnd.choice("xyé") + w[i + 1 :], w.upper()))
            words.append(w)
        rows.append((k, rnd.choice((" ", ", ", "\n", "1")).join(words)))
    rows += [(7, None), (8, ""), (9, "A" * 60_000 + " " + "A" * 60_000 + "b"), (9, ("A" * 60_000 + " ") * 2)]
    for noise in (0, 31, 3):
        assert _rows(spelling_variants(odd(spark, rows).repartition(5), noise=noise)) == _variants(rows, noise=noise)
    assert spelling_variants(odd(spark, rows).limit(0)).count() == 0


def test_ties_and_chains(spark):
    text = " ".join(["abcdefgh"] * 400 + ["abcdefg"] * 40 + ["abcdefx"] * 4 + ["zbcdefx"] * 2 + ["mmmmmmmm"] * 20 + ["mmmmmmmn"] * 20 + ["mmmmmmm"] * 2)
    got = {r.word: r for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["abcdefx"].form == "abcdefg" and got["abcdefx"].root == "abcdefgh" and got["abcdefg"].form_n == 400
    assert got["mmmmmmm"].form == "mmmmmmmm" and got["mmmmmmmm"].form is None and got["mmmmmmmm"].root == "mmmmmmmm"
    assert (got["zbcdefx"].form, got["zbcdefx"].n_near) == (None, 1)


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert _rows(queries.op13_spelling_variants(spark, SMALL)) == _variants(rows)
