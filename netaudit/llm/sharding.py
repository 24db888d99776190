"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.llm.common import Scratch, free

SHARDS, SEED = 24, 11


def hypergeometric(u: str, good: str, bad: str, n: str) -> str:
    """SQL of how many of n rows drawn from good + bad rows are good, as the uniform number u (from 0, below 1) says. All four are SQL of long or double values.

    Inversion from the mode outward: probabilities follow each other by their ratios, relative to that of the mode, so neither factorials nor their
    rounding come in. Two sums run over the values within 12 standard deviations and 40 more; what lies beyond is smaller than a double can tell."""
    ratio_up = "CAST(d.g - (v.m + i - 1) AS DOUBLE) * (d.n - (v.m + i - 1)) / (CAST(v.m + i AS DOUBLE) * (d.b - d.n + v.m + i))"
    ratio_down = "CAST(v.m - i + 1 AS DOUBLE) * (d.b - d.n + v.m - i + 1) / (CAST(d.g - v.m + i AS DOUBLE) * (d.n - v.m + i))"
    upto = "IF({0} < 1, array(), sequence(1L, {0}))"
    total = "aggregate({0}, named_struct('w', 1D, 's', 0D), (a, i) -> named_struct('w', a.w * ({1}), 's', a.s + a.w * ({1})), a -> a.s)"
    steps = "aggregate({0}, named_struct('w', 1D, 's', 0D, 'k', 0L), (a, i) -> named_struct('w', a.w * ({1}), 's', a.s + a.w * ({1}), 'k', a.k + IF(a.s < {2}, 1L, 0L)), a -> a.k)"
    up, down = upto.format("v.up"), upto.format("v.down")
    within = "CAST(ceil(12 * sqrt(d.n * (d.g / (d.g + d.b)) * (d.b / (d.g + d.b)) * ((d.g + d.b - d.n) / greatest(d.g + d.b - 1, 1))) + 40) AS BIGINT)"
    mode = "least(least(d.n, d.g), greatest(greatest(0L, d.n - d.b), CAST(floor((d.n + 1D) * (d.g + 1D) / (d.g + d.b + 2D)) AS BIGINT)))"
    # t.t is what u asks for: below 1 the mode itself, then the values above it, then those below
    pick = f"CASE WHEN t.t < 1 THEN v.m WHEN t.t < 1 + t.up THEN v.m + {steps.format(up, ratio_up, '(t.t - 1)')} ELSE v.m - {steps.format(down, ratio_down, '(t.t - 1 - t.up)')} END"
    sums = f"transform(array(named_struct('up', {total.format(up, ratio_up)}, 'down', {total.format(down, ratio_down)})), x -> named_struct('t', d.u * (1 + x.up + x.down), 'up', x.up))[0]"
    chosen = f"greatest(v.m - v.down, least(v.m + v.up, transform(array({sums}), t -> {pick})[0]))"
    bounds = f"named_struct('m', m, 'up', least(least(d.n, d.g) - m, {within}), 'down', least(m - greatest(0L, d.n - d.b), {within}))"
    return (
        f"transform(array(named_struct('u', {u}, 'g', {good}, 'b', {bad}, 'n', {n})), d -> "
        f"IF(d.n = 0 OR d.g = 0, 0L, IF(d.b = 0, d.n, transform(transform(array({mode}), m -> {bounds}), v -> {chosen})[0])))[0]"
    )


def uniform(*parts: str) -> str:
    """SQL of a uniform number from 0 on, below 1, with 53 bits, that hangs on the parts alone."""
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) * {2.0**-53!r}D)"


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, cells) for counts(part, n), one row a partition: cells[s] rows of it go to shard s. The matrix is drawn from all ways of dealing the rows
    to shards of sizes at most one apart, each as likely as it has orders of rows.

    Partitions are halved again and again: of the rows of a node, those in its left half take a multivariate hypergeometric draw from its
    cells, one shard after the other, and the right half takes the rest. Nodes hold one number for each partition and shard; after six
    levels they are dealt out over tasks."""
    n_parts = counts.count()
    total = "aggregate(counts, 0L, (a, x) -> a + x.n)"
    size = f"({total} div {shards} + IF(s < {total} % {shards}, 1L, 0L))"
    nodes = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("counts")).select(F.lit(0).alias("lo"), "counts")
    nodes = nodes.withColumn("cells", F.expr(f"transform(sequence(0, {shards - 1}), s -> {size})"))
    drawn = hypergeometric(uniform(f"{seed}L", "lo", "size(counts)", "s"), "cells[s]", "a.rest - cells[s]", "a.k")
    drawn = f"aggregate(sequence(0, {shards - 1}), named_struct('k', left, 'rest', total, 'out', CAST(array() AS ARRAY<BIGINT>)), (a, s) -> transform(array({drawn}), x -> named_struct('k', a.k - x, 'rest', a.rest - cells[s], 'out', concat(a.out, array(x))))[0], a -> a.out)"
    for level in range((max(1, n_parts) - 1).bit_length()):
        if level and level % 6 == 0:
            nodes = nodes.repartition(-(-n_parts // 64), "lo")
        nodes = nodes.withColumn("half", F.expr("size(counts) div 2")).withColumn("total", F.expr(total))
        nodes = nodes.withColumn("left", F.expr("aggregate(slice(counts, 1, half), 0L, (a, x) -> a + x.n)")).withColumn("drawn", F.expr(drawn))
        nodes = nodes.withColumn("child", F.explode(F.expr("""filter(array(named_struct('lo', lo, 'counts', slice(counts, 1, half), 'cells', drawn),
            named_struct('lo', lo + half, 'counts', slice(counts, half + 1, size(counts) - half), 'cells', zip_with(cells, drawn, (c, x) -> c - x))), x -> size(x.counts) > 0)""")))
        nodes = nodes.select("child.*")
    return nodes.where("size(counts) = 1").select(F.expr("counts[0].part").alias("part"), "cells")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row of docs, all columns kept, then shard (from 0 on) and slot, its place in the shard, gapless from 0; where docs has a column of
    that name, the added one has an underscore before it. Shard sizes are at most one apart, larger ones first, and every order of the rows over all places is equally likely.

    1. Each partition permutes its rows, numbers them and writes them.
    2. The communication matrix says how many rows of each partition each shard gets, exactly (communication_matrix).
    3. A partition's rows go to shards in runs of these lengths, in their permuted order.
    4. The exchange is a range sort by shard and a second random key, which permutes within shards; prefix sums of the sorted partitions' counts,
       one number a partition, make slots (these sums are broadcast; their number is that of the sorted partitions). So a shard may be larger than any task holds.

    The law is on rows: texts play no part, so nulls, empty and very long texts and copies are rows like any other, and no group can make a shard large. Repeated rows and ids are dealt one
    by one. With fewer rows than shards some shards are empty; an empty table gives an empty result. The result is a written table."""
    scratch = Scratch(docs.sparkSession)
    low = F.lit((1 << 33) - 1)  # of a generated number, the bits within a partition
    part = F.shiftright("at", 33).alias("part")
    held = scratch.write(docs.select(F.struct("*").alias("row"), F.rand(seed).alias("first")).sortWithinPartitions("first").select("row", F.monotonically_increasing_id().alias("at")))
    counts = scratch.write(held.groupBy(part).agg(F.count("*").alias("n")))
    ends = F.expr(f"transform(sequence(1, {shards}), s -> aggregate(slice(cells, 1, s), 0L, (a, x) -> a + x))")
    matrix = scratch.write(communication_matrix(counts, shards, seed).select("part", ends.alias("ends")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    dealt = held.select("row", "at", part).join(matrix, "part")
    dealt = dealt.select("row", F.size(F.filter("ends", lambda end: end <= F.col("at").bitwiseAND(low))).alias("shard"), F.xxhash64(F.lit(seed + 1), "at").alias("key"), "at")
    order = ["shard", "key", "at"]
    placed = scratch.write(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "shard", F.monotonically_increasing_id().alias("at")))
    scratch.close(placed)
    before = placed.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = F.col("shard") * F.lit(n // shards) + F.least("shard", F.lit(n % shards))
    slot = F.col("before") + F.col("at").bitwiseAND(low) - start
    return placed.select("row", "shard", "at", part).join(F.broadcast(before), "part").select("row.*", *[c.alias(name) for c, name in zip((F.col("shard"), slot), free(docs, "shard", "slot"), strict=True)])


def digest(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What op11 returns of sharded rows: sizes and checksums of the texts that were moved."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return sharded.select(id_col, (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
