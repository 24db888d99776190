"""Grouping of spelling variants by asymmetric q-chunks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaudit.llm.common import Scratch, join_groups
from netaudit.llm.words import slices

#: Fixed values of the contract: what a run is, the least length and number of a word, and how much more often a form must occur than its variant.
RUN = "[A-Za-zÀ-ÿ]+"
LENGTH, OFTEN, TIMES = 7, 2, 10
#: Words that a task counts before it hands them on, and pairs under one key that are looked at without splitting further. Neither changes a result.
_HELD, _PAIRS = 1 << 18, 256
_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def _words(length: int, noise: int):
    """Rows (word, n): a task's words of at least this length. If noise > 0 divides the checksum of `<id>:<run>`, the run loses the code point it names."""
    find = re.compile(RUN).findall

    def row(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for raw, n in Counter(w for w in find(text or "") if len(w) >= length).items():
                        word = _lower(raw)
                        h = zlib.crc32(word.encode(), start) if noise else 1
                        if noise and h % noise == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < length:
                                continue
                        held[word] += n
                if len(held) > _HELD:
                    yield row(held)
                    held.clear()
        yield row(held)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, often: int = OFTEN, noise: int = 0) -> DataFrame:
    """(word, n): distinct words of all texts, A-Z lower-cased, with their occurrences, if there are `often` at least. Counted in the tasks before the shuffle."""
    rows = docs.select(docs[f"`{id_col}`"].cast("string").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(_words(length, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _split(rows: DataFrame) -> DataFrame:
    """One more chunk of what is left of each row (key, role, word, n, at, len). A word that gives chunks (role 0) is cut in two halves: each is a chunk,
    and the other half is what is left. A longer word (role 1) gives the grams that such a chunk of a word one shorter can be, which lie at
    the chunk's place or one behind it: of those the first chunk's at its place and the second's one behind, as an insertion leaves the first in place
    or moves the whole of the second."""
    half = "CAST((len - role) div 2 AS INT)"
    cut = lambda k, a, n, rest, left: f"named_struct('key', xxhash64(key, {k}, substring(word, {a} + 1, {n})), 'at', {rest}, 'len', {left})"
    both = f"array({cut(1, 'at', half, f'at + {half}', f'len - {half}')}, {cut(2, f'at + {half} + role', f'len - {half} - role', 'at', f'{half} + role')})"
    return rows.withColumn("part", F.explode(F.expr(both))).select("part.key", "role", "word", "n", "part.at", "part.len")


def near_pairs(words: DataFrame, scratch: Scratch, pairs: int = _PAIRS) -> DataFrame:
    """(word, n, other, other_n), each pair of words(word, n) once, that differ by exactly one inserted, deleted or replaced code point. Words are distinct.

    One edit spares one of two disjoint chunks. So of two words of one length both give chunks, which meet in place; of two whose lengths differ by one the shorter gives two
    chunks and the longer its grams within one place of them. Rows meet on chunk, place and length, and what meets is verified.
    A key under which more than `pairs` pairs would meet is split: what is left of its words differs by one edit as well, so it is cut into two chunks again, and
    so on, down to one code point, where a group is as large as the alphabet allows. So a common half of words makes no large group, and
    the number of pairs looked at follows the number of words."""
    rows = words.select(F.length("word").alias("len"), "word", "n").where("len > 0")
    rows = rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), "*").select((F.col("len") - F.col("role")).cast("long").alias("key"), "role", "word", "n", F.lit(0).alias("at"), "len")
    todo, met = rows.where("key > 0"), []
    while True:
        todo = scratch.write(_split(todo))
        found = todo.groupBy("key").agg(F.sum(1 - F.col("role")).alias("c"), F.sum("role").alias("g"), F.max(F.col("len") - F.col("role")).alias("left"))
        found = scratch.write(found.where("c > 0 AND c + g > 1").withColumn("more", F.expr(f"c * (c - 1) / 2 + c * g > {pairs} AND left > 1")).withColumn("rows", F.expr("c + g")))
        few = scratch.write(join_groups(todo, found.where("NOT more").select("key", "rows"), ["key"], "rows").drop("rows"))
        l, r = few.where("role = 0").alias("l"), few.alias("r")
        edit = F.levenshtein(F.col("l.word"), F.col("r.word"), 1)
        pair = l.join(r, "key").where("r.role = 1 OR l.word < r.word").where(edit == 1)
        met.append(scratch.write(pair.select(F.col("l.word").alias("word"), F.col("l.n").alias("n"), F.col("r.word").alias("other"), F.col("r.n").alias("other_n")).distinct()))
        many = found.where("more").select("key", "rows")
        if many.isEmpty():
            break
        todo = join_groups(todo, many, ["key"], "rows").drop("rows")
    out = met[0]
    for m in met[1:]:
        out = out.unionByName(m)
    return out.distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, often: int = OFTEN, times: int = TIMES, noise: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the texts that has `length` code points and `often` occurrences at least: the number of words
    one edit away, of these the most frequent one (ties: the first in code-point order) as form if it occurs `times` times as often, and the
    word where a chain of forms ends as root.

    Chains are followed by joins of the words that have a form; each step multiplies the number of occurrences by `times` at least, so
    there are few.

    Null and empty texts have no words. A very long text is counted like any other, a very long run is one word. Repeated rows count again; a null id reads as an empty one. An
    empty table gives an empty result. Other columns of docs don't matter, whatever their names."""
    if times < 2:
        raise ValueError("times must be 2 at least")
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(word_counts(docs, id_col, text_col, length, often, noise))
    pairs = scratch.write(near_pairs(words, scratch))
    ways = pairs.union(pairs.select("other", "other_n", "word", "n"))
    near = ways.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    forms = scratch.write(near.select("word", "n_near", F.expr(f"IF(-best.less >= {times} * n, best.other, NULL)").alias("form"), F.expr(f"IF(-best.less >= {times} * n, -best.less, NULL)").alias("form_n")))
    step = forms.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("next"))
    left, ends = step.select(F.col("at").alias("word"), F.col("next").alias("root")), []
    while True:
        left = scratch.write(left.join(step, F.col("root") == F.col("at"), "left").select("word", "root", "next"))
        ends.append(left.where("next IS NULL").select("word", "root"))
        left = left.where("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if left.isEmpty():
            break
    roots = ends[0]
    for e in ends[1:]:
        roots = roots.unionByName(e)
    out = words.join(forms, "word", "left").join(roots, "word", "left")
    out = scratch.write(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    scratch.close(out)
    return out
