"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations; DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.llm.common import Scratch, free, join_groups, quoted

#: No source is read more often than this, and the most plentiful source is read once.
REPEATS = 2.0
BLOCK_TOKENS, STEPS = 1 << 20, 50


def n_tokens(text: Column) -> Column:
    """Words of a text, at least 1, so that every row has a place in the budget."""
    return F.greatest(F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")), F.lit(1)).cast("long")


def weights(totals: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, steps: int = STEPS) -> DataFrame:
    """totals(source, tokens), a written table with one row a source → (source, tokens, share, alpha, weight, budget, epochs).

    weight is share ** alpha, normalised. alpha is bisected in [0, 1]: towards the flattest mix in which no source is
    read more than `repeats` times when the most plentiful relative to its weight is read once (the ratio of shares to the power
    1 - alpha), or, if `entropy` is given, the mix whose entropy is that many nats, as nearly as [0, 1] allows. budget is
    the tokens that a source gets: weight times the whole, where the whole is the least that reads every source at
    least once. Only sums, least and greatest of the sources' totals come to the driver; with `entropy` one aggregate a step."""
    one = totals.agg(F.sum(F.col("tokens").cast("double")).alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    whole = float(one["all"] or 1.0)
    share = F.col("tokens") / F.lit(whole)

    def too_flat(alpha: float) -> bool:
        if one["most"] is None:
            return False
        if entropy is None:
            return (one["most"] / one["least"]) ** (1 - alpha) > repeats
        p = F.pow(share, F.lit(alpha))
        z, plogp = totals.agg(F.sum(p), F.sum(p * F.log(p))).first()
        return log(z) - plogp / z > entropy

    low, high = 0.0, 1.0
    if not too_flat(0.0):
        high = 0.0
    else:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if too_flat(mid) else (low, mid)
    weight = F.pow(share, F.lit(high))
    z, longest = totals.agg(F.sum(weight), F.max(F.col("tokens") / weight)).first()
    parts = totals.select("source", "tokens", share.alias("share"), F.lit(high).alias("alpha"), (weight / F.lit(z or 1.0)).alias("weight"), F.greatest(F.round(weight * F.lit(longest or 0.0)).cast("long"), F.col("tokens")).alias("budget"))
    return parts.withColumn("epochs", F.col("budget") / F.col("tokens"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: float | None = REPEATS, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """Rows of docs, each as often as the mix reads it: all columns, then mix_pass (0, 1, …), mix_tokens, mix_block and
    mix_start, the row's first token in its source's stream of passes; where docs has a column of that name, the added one has an
    underscore before it.

    Each source is dealt into blocks by a hash; in each pass the blocks come in another order, and the rows of a block
    too. A source's stream is its passes one after the other, cut at its budget: a row is read if it begins before the
    end, so a source overshoots by less than one row. Places are prefix sums in three levels: over spans of the blocks'
    order, over the blocks of a span and over the rows of a block, so no task holds a source, nor all its blocks. The number of blocks follows the source's tokens.

    A null source is a source of its own. Null and empty texts count one token; a very long text is one row like any other. Rows that repeat an id are rows of their own, ordered among
    themselves by their text's hash; identical rows share a place. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    small = docs.select(key.alias("source"), F.xxhash64(id_col, text_col).alias("k"), n_tokens(F.col(text_col)).alias("n"))
    small = scratch.write(small.groupBy("source", "k").agg(F.max("n").alias("n"), F.count("*").alias("copies")))
    totals = scratch.write(small.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.count("*").alias("texts")))
    plan = scratch.write(weights(totals, repeats, entropy).join(totals.select("source", "texts"), "source"))
    dealt = join_groups(small, plan.select("source", "tokens", "budget", "texts"), ["source"], "texts").withColumn("blocks", F.ceil(F.col("tokens") / block_tokens)).withColumn("block", F.pmod(F.xxhash64("k", F.lit(seed)), F.col("blocks")))
    passes = dealt.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("tokens")).cast("int") - 1)))
    order = F.xxhash64("block", "pass", F.lit(seed))
    per_block = scratch.write(passes.groupBy("source", "pass", "block").agg(F.sum(F.col("n") * F.col("copies")).alias("block_tokens")).withColumn("order", order).withColumn("span", F.shiftright("order", 52)))
    ahead_of = lambda value, by: F.coalesce(F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = per_block.groupBy("source", "pass", "span").agg(F.sum("block_tokens").alias("span_tokens"), F.count("*").alias("in_span"))
    spans = scratch.write(spans.withColumn("first", ahead_of("span_tokens", Window.partitionBy("source", "pass").orderBy("span"))).select("source", "pass", "span", "first", "in_span"))
    starts = join_groups(per_block, spans, ["source", "pass", "span"], "in_span").withColumn("before", F.col("first") + ahead_of("block_tokens", Window.partitionBy("source", "pass", "span").orderBy("order", "block"))).select("source", "pass", "block", "before")
    within = Window.partitionBy("source", "pass", "block").orderBy(F.xxhash64("k", "pass", F.lit(seed)), "k")
    placed = passes.withColumn("ahead", ahead_of(F.col("n") * F.col("copies"), within)).join(starts, ["source", "pass", "block"])
    placed = placed.withColumn("mix_start", F.col("pass").cast("long") * F.col("tokens") + F.col("before") + F.col("ahead")).where("mix_start < budget")
    s, k, reads, one, copies = free(docs, "_source", "_key", "_reads", "_read", "_copies")
    each = placed.groupBy("source", "k").agg(F.sort_array(F.collect_list(F.struct("pass", F.col("n").alias("tokens"), "block", "mix_start"))).alias(reads), F.max("copies").alias(copies))
    each = scratch.write(each.withColumnsRenamed({"source": s, "k": k}))
    scratch.close(each)
    out = join_groups(docs.select("*", key.alias(s), F.xxhash64(id_col, text_col).alias(k)), each, [s, k], copies)
    out = out.select(*quoted(docs.columns), F.explode(reads).alias(one))
    return out.select(*quoted(docs.columns), *[F.col(f"{one}.{c}").alias(n) for c, n in zip(("pass", "tokens", "block", "mix_start"), free(docs, "mix_pass", "mix_tokens", "mix_block", "mix_start"), strict=True)])
