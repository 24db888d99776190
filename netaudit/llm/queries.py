"""The registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netaudit.llm import language_id, quality, sharding
from netaudit.llm.alignment import align
from netaudit.llm.common import table
from netaudit.llm.exact_dedup import exact_dedup
from netaudit.llm.html_text import html_text
from netaudit.llm.line_dedup import LEAST_PAGES, RATIO, host_of, line_dedup, lines_of
from netaudit.llm.mixing import mix
from netaudit.llm.ngram_join import ngram_components
from netaudit.llm.packing import pack
from netaudit.llm.quality_rules import quality_rules
from netaudit.llm.secret_scan import digest, secret_scan
from netaudit.llm.spelling import spelling_variants


#: The tokenizer that op9 and the pipeline pack for.
TOKENIZER = "byte_bpe_50k.json"
#: The tokenizer that op12 aligns with it.
PIECES = "piece_bpe_32k.model"
#: One in so many runs of a document loses a code point before op13 counts it.
NOISE = 31


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.learn(docs.where(F.col("doc_id").isNotNull() & ~out))
    return language_id.identify(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    model = quality.learn(docs, labels.where(~out))
    return quality.score(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return line_dedup(pages, host_of(F.col("url")), lines_of(F.col("html")), "page_id")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_pass", "mix_tokens", "mix_block", "mix_start")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES), digest=True)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), noise=NOISE).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_html_extraction, op2_language_id, op3_quality, op4_secret_scan, op5_exact_dedup, op6_line_dedup, op7_ngram_join, op8_quality_rules, op9_packing,
        op10_mixing, op11_sharding, op12_alignment, op13_spelling_variants, pipeline,
    )
    return {f.__name__: f for f in ops}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"

#: (kind, regex, group, least, is a base kind), as in secret_scan.
_KINDS = [
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{15,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35,}", 0, 1),
]


def _secret_sql() -> str:
    parts = [
        f"""SELECT row, {k} AS k, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum([0] || list_transform(m[1:i - 1], lambda x: length(x))), 'n': length(m[i]), 'inner': length(n[i])}})) AS p, {least} AS least
        FROM (SELECT row, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {group}) AS n, string_split_regex(text, '{regex}') AS g FROM d)"""
        for k, (kind, regex, group, least) in enumerate(_KINDS)
    ]
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({' UNION ALL '.join(parts)}), f AS (SELECT row, k, kind, p.s::BIGINT AS s, (p.s + p.n)::BIGINT AS e FROM s WHERE p.inner >= least),
    a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"""


def _spelling_sql() -> str:
    """crc32 by its table, near words by what they have in common with one code point left out."""
    low = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)"
    entry = "k::BIGINT"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda x: {step})[1]"
    crc = "xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, tab[(xor(c % 256, b) + 1)::BIGINT])), 4294967295)"
    return f"""WITH t AS (SELECT list({entry} ORDER BY k) AS tab FROM range(256) r(k)),
    r AS (SELECT doc_id, {low} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
    b AS (SELECT run, n, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT) AS bytes FROM (SELECT run, n, hex(doc_id || ':' || run) AS h FROM r)),
    c AS (SELECT run, n, {crc} AS h FROM b, t),
    e AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM c),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
    v AS (SELECT word, n, word AS part, 0 AS i FROM w UNION ALL SELECT word, n, left(word, i - 1) || substr(word, i + 1), i FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
    p AS (SELECT DISTINCT a.word, a.n, o.word AS other, o.n AS m FROM v a JOIN v o USING (part) WHERE a.word <> o.word AND (a.i = o.i OR a.i = 0 OR o.i = 0)),
    f AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS m, any_value(n) AS n FROM p GROUP BY 1),
    g AS (SELECT word, n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM f),
    z AS (WITH RECURSIVE q AS (SELECT word, form AS root FROM g WHERE form IS NOT NULL UNION ALL SELECT q.word, g.form FROM q JOIN g ON g.word = q.root WHERE g.form IS NOT NULL) SELECT q.word, q.root FROM q LEFT JOIN g ON g.word = q.root WHERE g.form IS NULL)
    SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN g USING (word) LEFT JOIN z USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secret_scan": _secret_sql(),
        "op13_spelling_variants": _spelling_sql(),
        "op5_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
        "op6_line_dedup": rf"""WITH p AS (SELECT row_number() OVER () AS row, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
              list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
              '[\r\n]', ' ', 'g'), '(?i)</?(?:{_BLOCK_TAGS})(?:[ \t/][^>]*)?>', chr(10), 'g'), '<[A-Za-z/!?][^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
            total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
            held AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
            gone AS (SELECT host, line FROM held JOIN total USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages),
            each AS (SELECT row, host, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM p),
            kept AS (SELECT row, string_agg(line, chr(10) ORDER BY place) AS clean_text, count(*) AS n FROM each ANTI JOIN gone USING (host, line) GROUP BY row)
            SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, coalesce(clean_text, '') AS clean_text FROM p LEFT JOIN kept USING (row)""",
    }
