"""Cases that a shortened job would get wrong."""

import os
import random
import string
from collections import Counter

import pytest
import zstandard

from netaudit.llm.quality_rules import bands, quality_rules

SF = "/root/testdata/sf0.001"


def noise(rng, size, width=60):
    t = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=size))
    return " ".join(t[k : k + width] for k in range(0, size, width))[:size]


def prose(rng, size):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "st", "ou", "al", "ing", "ion", "ment", "qu", "ck"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(size))[:size]


@pytest.mark.parametrize("size", [700, 1000, 2000, 4096, 8000, 30000])
def test_quality_rules_reject_noise_of_any_length(spark, size):
    rng = random.Random(size)
    rows = [(1, noise(rng, size)), (2, prose(rng, size)), (3, noise(rng, size, 20))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [got[k].kept for k in (1, 2, 3)] == [False, True, False] and not any(r.base_failed for r in got.values())


@pytest.mark.parametrize(("first", "size"), [(5000, 8191), (4096, 8000), (4096, 8192), (12288, 16383)])
def test_the_end_of_a_text_lies_in_a_chunk(first, size):
    rng, packer = random.Random(size), zstandard.ZstdCompressor(level=3)
    text = (prose(rng, first) + " " + noise(rng, size))[:size].encode()
    assert len(text) == size
    whole, odd, _ = bands(text, packer)
    assert whole >= 1.4 and odd == 1 / -(-size // 4096)
    assert bands(text[:4096], packer)[1] == 0.0 and bands(prose(rng, 9000).encode(), packer)[1:] == (0.0, True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_language_stage_drops_gibberish_and_foreign_scripts(spark):
    import corpus_pipeline

    rng = random.Random(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    junk = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 10))) for _ in range(80)), noise(rng, 2000), "日本語の文章がここにある。これは別の言語です。" * 5, "Это совсем другой язык, которого модель никогда не видела", "123 ### 456"]
    both = docs.union(spark.createDataFrame([(-k, t, None) for k, t in enumerate(junk, 1)], "doc_id long, text string, lang string"))
    left = {r.doc_id for r in corpus_pipeline.languages(spark, both, SF).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.where(r"text RLIKE '\\p{L}'").select("doc_id").collect()}


def test_pipeline_by_hand_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline
    from netaudit.llm.packing import Encoder
    from netaudit.llm.queries import tokenizer_path

    rng = random.Random(9)
    base = [prose(rng, 600) for _ in range(8)]
    near = [f"{t} tail{k}" for k, t in enumerate(base)]
    a, b, c, d, e, f, g, h = base
    rows = [(1, a), (1, a), (2, a), (2, a.upper()), (None, b), (None, b), (None, near[1]), (None, b + " other end"), (5, c), (5, near[2]), (5, d), (5, near[3]), (6, c + " more"), (7, e), (7, e.upper()), (None, e), (3, f), (None, f), (None, near[5]), (8, g), (None, h), (9, "12 ###"), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    low = lambda t: t.lower()
    texts = {}
    for i, t in rows:
        if t and any(x.isalpha() for x in t):
            texts[low(t)] = max(texts.get(low(t), -1), -1 if i is None else i)
    sets = {t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts}
    group = {}
    for t in texts:
        group[t] = next((group[u] for u in group if len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])), len(group))
    least = {}
    for t, i in texts.items():
        least.setdefault(group[t], []).append(i)
    want = Counter({(k, min((i for i in v if i >= 0), default=None)): 1 for k, v in least.items()})

    stage = docs
    for _, run in corpus_pipeline.STAGES[:3]:
        stage = corpus_pipeline.materialize(run(spark, stage, str(tmp_path)))
    left = stage.collect()
    assert Counter((group[low(r.text)], r.doc_id) for r in left) == want
    encoder = Encoder(tokenizer_path())
    tokens = Counter((r.doc_id, len(encoder.ids(r.text)) + 1) for r in left)
    packed = Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.start == 0)
    assert packed.keys() == tokens.keys() and all(tokens[k] <= n <= 2 * tokens[k] for k, n in packed.items())
