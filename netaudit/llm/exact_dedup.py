"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.llm.common import Scratch, ascii_lower, free, join_groups, quoted, row_hashes

BLOCK = 16384


def normal(text_col: str) -> Column:
    """The text that equality is of: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def once(value: Column) -> Column:
    """The value as a generated column, which is worked out once a row however often it is used."""
    return F.explode(F.array(value))


def ranked(scratch: Scratch, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with name, their place from 0 on in the order of the keys, whatever the number of partitions: a range sort, then prefix sums
    of the partitions' counts, one number a partition. Written before use, so every later reader sees the same names."""
    place = scratch.write(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    before = place.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return place.select("*", part).join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("name"))


def block_names(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(id, r1, r2, n_blocks, name, copies): for each id and text (r1 and r2 are its row_hashes) its number of rows and one integer identity
    of the text. Texts are equal if and only if they have equal (n_blocks, name), but for rows whose 128 bits over id and text are equal (2^-128 a pair).

    Texts are cut in blocks of `block` characters. Distinct blocks are sorted and named by integers: blocks are gathered
    by their hash and compared as texts, so a hash collision costs time and not exactness. Then adjacent names are
    paired, distinct pairs sorted and named, and so on, until each text has one name; the number of rounds is the
    logarithm of the longest text in blocks. Block texts are shuffled once; later rounds move integers only. Copies
    meet in map-side sets before the shuffle, so a hot text costs one row a task, and names of hot blocks are broadcast."""
    t = F.col("t")
    cut = F.when(F.char_length(t) <= block, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    texts = docs.select(F.col(id_col).alias("id"), once(normal(text_col)).alias("t"))
    rows = texts.select("id", *row_hashes("id", t), F.transform(cut, lambda x: F.xxhash64(x)).alias("hashes"))
    rows = scratch.write(rows.groupBy("r1", "r2").agg(F.first("id").alias("id"), F.first("hashes").alias("hashes"), F.count("*").alias("copies")))
    parts = texts.select(F.explode(cut).alias("content"))
    by_hash = scratch.write(parts.groupBy(F.xxhash64("content").alias("bh")).agg(F.sort_array(F.collect_set("content")).alias("contents"), F.count("*").alias("uses")).select("bh", F.size("contents").alias("many"), F.when(F.size("contents") > 1, F.col("contents")).alias("clash"), "uses"))
    names = scratch.write(ranked(scratch, by_hash.select("bh", "uses", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("rank")), ["bh", "rank"]))
    key = ["r1", "r2"]
    each = rows.select(*key, F.size("hashes").alias("n_blocks"), F.posexplode("hashes").alias("i", "bh"))
    clashes = by_hash.where("clash IS NOT NULL").select("bh", "clash")
    if clashes.isEmpty():
        cur = join_groups(each, names.select("bh", "name", "uses"), ["bh"], "uses")
    else:  # several texts under one hash: the rank among them tells them apart
        cells = texts.select(*row_hashes("id", t), F.posexplode(cut).alias("i", "content")).withColumn("bh", F.xxhash64("content")).join(clashes, "bh", "left")
        cells = cells.select(*key, "i", F.coalesce(F.array_position("clash", F.col("content")) - 1, F.lit(0)).cast("int").alias("rank")).distinct()
        cur = each.join(cells, [*key, "i"]).join(names.select("bh", "rank", "name"), ["bh", "rank"])
    cur = scratch.write(cur.select(*key, "n_blocks", "i", "name"))
    done, left = cur.where("n_blocks = 1").select(*key, "n_blocks", "name"), cur.where("n_blocks > 1")
    longest, level = cur.agg(F.max("n_blocks")).first()[0] or 1, 0
    while longest > 1:
        longest, level = (longest + 1) // 2, level + 1
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = scratch.write(left.groupBy(*key, "n_blocks", F.floor(F.col("i") / 2).cast("int").alias("j")).agg(half(0).alias("a"), F.coalesce(half(1), F.lit(-1)).alias("b")))
        named = scratch.write(ranked(scratch, pairs.groupBy("a", "b").agg(F.count("*").alias("uses")), ["a", "b"]))
        left = join_groups(pairs, named, ["a", "b"], "uses").select(*key, "n_blocks", F.col("j").alias("i"), "name")
        ends = F.ceil(F.log2("n_blocks")) == level
        done, left = done.unionByName(left.where(ends).select(*key, "n_blocks", "name")), left.where(~ends)
    return rows.drop("hashes").join(done, key).select("id", *key, "n_blocks", "name", "copies")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A written table (r1, r2, copies, keep_id, group_size, kept), one row for each id and text of docs: its row_hashes over the id and the
    normal text, its rows, and what exact_dedup says of them."""
    scratch = Scratch(docs.sparkSession)
    named = scratch.write(block_names(scratch, docs, id_col, text_col, block))
    groups = scratch.write(named.groupBy("n_blocks", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("members")))
    out = join_groups(named, groups, ["n_blocks", "name"], "members")
    out = scratch.write(out.select("r1", "r2", "copies", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")))
    scratch.close(out)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every row of docs, all columns kept, then keep_id, group_size, kept and text_sha256; where docs has a column of that name, the added
    one has an underscore before it.

    Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. Of equal texts the row
    with the largest id stays (a null id is smaller than any other). Rows that repeat an id with the same text count in
    group_size and are all marked kept if that id stays; rows that repeat an id with another text belong to that text's
    group. Very long texts are named block by block. An empty table gives an empty result. Rows meet their group by 128 bits over id and text: rows of
    different texts would share an answer with a chance of 2^-128 a pair. Names themselves are exact: blocks are compared as texts."""
    found = exact_groups(docs, id_col, text_col, block)
    r1, r2, copies, t = free(docs, "_r1", "_r2", "_copies", "_t")
    names = free(docs, "keep_id", "group_size", "kept", "text_sha256")
    found = found.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("copies").alias(copies), *[F.col(c).alias(n) for c, n in zip(("keep_id", "group_size", "kept"), names, strict=False)])
    rows = docs.select("*", once(normal(text_col)).alias(t))
    rows = rows.select(*quoted(docs.columns), *[h.alias(n) for h, n in zip(row_hashes(id_col, F.col(t)), (r1, r2), strict=True)], F.sha2(t, 256).alias(names[3]))
    return join_groups(rows, found, [r1, r2], copies).select(*quoted(docs.columns), *names)
