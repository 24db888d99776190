"""N-gram Jaccard self-join by token-combination prefixes, with connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from netaudit.llm.common import Scratch, components, join_groups, row_hashes
from netaudit.llm.words import mixed, shingles, slices, word_hashes

_U = np.uint64
#: Bits of a place in the sketch of token counts, and places in a row of its tables. Where a place is shared by many tokens, all of them count as frequent, and
#: only those far above the rest stand out in the order; so from some tens of thousands of documents on pairs carry the index. The result stays the same.
_BITS, _SLOT = 18, 1 << 14
#: A token is rare if its place in the sketch counts this many documents at most; all others are the frequent class.
RARE = 3
#: Index rows that a task holds back, and how many of them with one key make it a hot one, whose rows are dealt over so many salts.
_HELD, _HOT, _SALTS = 1 << 18, 64, 64
#: Sets of a bucket or component that meet in one task at once.
_CHUNK = 512
#: Components that share a key are paired up to this many; beyond it they meet in blocks.
CROWD = 12
#: Each of these picks a key of a node under which it meets others before components are verified; from the third on in crowds only.
#: They save work and change no result.
SEEDS = (1, 2, 3, 4)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """p of a set of n tokens: any two sets with a Jaccard similarity of percent / 100 share a token among the first p of each."""
    return n + (-n * percent // 100) + 1


def extended_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """The extended prefix, within which two linked sets have two shared tokens that are neighbours in both orders, if all tokens they share
    are frequent. Let a set of n tokens link with one of m, sharing s, and t = percent / 100. n + m - 2 s tokens are not shared, and they part
    the shared ones in at most one run more. So of the first n + m - 2 s + 2 shared tokens two are neighbours in both sets. In the set of n they lie
    within the first 2 n + m - 3 s + 2, as n - s of its tokens are not shared. s is t (n + m) / (1 + t) at least, and the bound is
    largest for the least m that can link, t n: (2 - 2 t) n + 2."""
    return 2 * (100 - percent) * n // 100 + 2


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _identity(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over a set, which with its size are its identity."""
    return mixed(mixed(s).sum(dtype=_U, keepdims=True) + _U(len(s))), mixed(s ^ _U(0x9E3779B97F4A7C15)).sum(dtype=_U, keepdims=True)


def _profiles(n: int, id_type: pa.DataType):
    """Rows (doc_id, r1, r2, n, h1, h2) of all texts, and at the end of a task its part of the sketch as rows (slot, part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << _BITS, np.int64)
        names = ["doc_id", "r1", "r2", "n", "h1", "h2", "slot", "part", "counts"]
        for whole in batches:
            for batch in slices(whole):
                sets = list(shingles(*word_hashes(batch.column("text")), n))
                at, times = np.unique(np.concatenate(sets) >> _U(64 - _BITS), return_counts=True)
                sketch[at.astype(np.int64)] += times
                both = [np.concatenate(h) for h in zip(*map(_identity, sets), strict=True)]
                k = len(sets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array([len(s) for s in sets], pa.int64()), *map(_longs, both), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        k, part = (1 << _BITS) // _SLOT, TaskContext.get().partitionId()
        counts = [zstandard.compress(sketch[i * _SLOT : (i + 1) * _SLOT].tobytes(), 1) for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * 5, pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part, np.int32)), pa.array(counts, pa.binary())], names=names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up parts of a slot, as they stream by."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, counts in zip(b.column("slot").to_pylist(), b.column("counts").to_pylist(), strict=True):
            sums[slot] = sums.get(slot, 0) + np.frombuffer(zstandard.decompress(counts), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["slot", "counts"])


def _sketch(parts: DataFrame) -> np.ndarray:
    """The whole sketch from the tasks' parts, added up in a tree of two levels; one table of fixed size comes to the driver."""
    k = (1 << _BITS) // _SLOT
    some = parts.repartition("slot", F.col("part") % 1024).mapInArrow(_added, "slot int, counts binary")
    sums = dict(some.repartition(k, "slot").mapInArrow(_added, "slot int, counts binary").collect())
    return np.concatenate([np.frombuffer(zstandard.decompress(sums[i]), np.int64) if i in sums else np.zeros(_SLOT, np.int64) for i in range(k)])


def keys_of(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare, pairs): the keys of a set in the index. Tokens stand in the order of their counts in the sketch. Rare tokens of the prefix are keys
    themselves; if the prefix holds a frequent one, the pairs of adjacent frequent tokens of the extended prefix are keys as well. (The first token that two
    linked sets share lies in both prefixes. Is it rare, it is a key of both; else all they share is frequent. A token whose place counts one document is in no
    other set and no key.)"""
    often = counts[(s >> _U(64 - _BITS)).astype(np.int64)]
    order = np.lexsort((s, often))
    s, often = s[order], often[order]
    p, alone, rare = int(prefix_lengths(np.int64(len(s)), percent)), *np.searchsorted(often, (1, RARE), "right").tolist()
    if rare >= p:
        return mixed(s[alone:p]), np.zeros(0, _U)
    f = s[rare : int(extended_lengths(np.int64(len(s)), percent))]
    return mixed(s[alone:rare]), np.unique(mixed(f[:-1] * _U(0xD6E8FEB86659FD93) + mixed(f[1:])))


def _salted(keys: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, tag, salt). A key that many sets of this batch share is hot: its rows are dealt by their tags over salts from 1 on, and two of
    them stay under salt 0 as well, to meet the rows that other tasks have there."""
    order = np.argsort(keys, kind="stable")
    keys, tags = keys[order], tags[order]
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(keys)))
    hot = np.repeat(n >= _HOT, n)
    early = np.arange(len(keys)) - np.repeat(first, n) < 2
    salt = np.where(hot, 1 + (mixed(tags) % _U(_SALTS)).astype(np.int32), 0).astype(np.int32)
    again = hot & early
    yield pa.RecordBatch.from_arrays([_longs(np.append(keys, keys[again])), _longs(np.append(tags, tags[again])), pa.array(np.append(salt, np.zeros(again.sum(), np.int32)))], names=["key", "h1", "salt"])


def _postings(n: int, percent: int, sketch, least: int):
    """Rows (key, h1, salt) of all sets; copies within a task mostly count once, which saves work and changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        keys, tags, held = [], [], 0
        for whole in batches:
            for batch in slices(whole):
                for s in shingles(*word_hashes(batch.column("text")), n):
                    if len(s) < least:
                        continue
                    tag = _identity(s)
                    mark = int(tag[0][0]) << 64 | int(tag[1][0])
                    if mark in seen:
                        continue
                    if len(seen) >= 1 << 16:
                        seen.clear()
                    seen.add(mark)
                    own = np.concatenate(keys_of(s, counts, percent))
                    keys.append(own)
                    tags.append(np.full(len(own), tag[0][0], _U))
                    held += len(own)
                if held >= _HELD:
                    yield from _salted(np.concatenate(keys), np.concatenate(tags))
                    keys, tags, held = [], [], 0
        if held:
            yield from _salted(np.concatenate(keys), np.concatenate(tags))

    return run


class _Block:
    """Sets held together: counts what another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """True for each set whose Jaccard similarity with s is percent / 100 at least."""
        a, b = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        n = b - a
        hit = n > 0
        a, n = a[hit], n[hit]
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.sizes))
        return 100 * shared >= percent * (len(s) + self.sizes - shared)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, n: int) -> Iterator[Iterator[tuple]]:
    """Runs of rows that are equal in their first columns, with the last column, a text, as its set; the stream is sorted."""

    def rows():
        for whole in batches:
            for b in slices(whole):
                rest = [b.column(c).to_pylist() for c in b.schema.names if c != "text"]
                yield from zip(*rest, shingles(*word_hashes(b.column("text")), n), strict=True)

    for _, run in groupby(rows(), key=lambda r: r[:keys]):
        yield run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _contracted(percent: int, n: int):
    """Groups (seed, key, chunk) of rows (node, text): the links within each group, as a star for each of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in _groups(batches, 3, n):
            nodes, sets = zip(*(r[3:] for r in rows), strict=True)
            if len(nodes) < 2:
                continue
            block, todo = _Block(list(sets)), set(range(len(nodes)))
            while todo:
                root = todo.pop()
                reach = [root]
                while reach and todo:
                    near = [int(i) for i in np.flatnonzero(block.linked(sets[reach.pop()], percent)) if i in todo]
                    todo.difference_update(near)
                    reach += near
                    found += [(nodes[i], nodes[root]) for i in near]
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _verified(percent: int, n: int):
    """Groups (comp, blk): first the rows of one block of that component (role 0), then the rows (other, node, text) of components that
    may link with it (role 1). Gives one link for each other component that has any with the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in _groups(batches, 2, n):
            nodes, sets, block, met = [], [], None, set()
            for _, _, role, other, node, s in rows:
                if role == 0:
                    nodes.append(node)
                    sets.append(s)
                    continue
                if other in met or not nodes:
                    continue
                block = block or _Block(sets)
                hit = np.flatnonzero(block.linked(s, percent))
                if len(hit):
                    met.add(other)
                    found.append((node, nodes[int(hit[0])]))
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _crossed(percent: int, n: int):
    """Groups (key, block, block) of rows (role, comp, node, text): the nodes of one block (role 0) and of another (role 1), or of one block with itself.
    Gives links between different components, as few as join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 5, n):
            held, block, found, parent = [], None, [], {}

            def root(c):
                while parent.setdefault(c, c) != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            def ask(comp, node, s):
                for k in np.flatnonzero(block.linked(s, percent)).tolist():
                    a, b = root(comp), root(held[k][0])
                    if a != b:
                        parent[a] = b
                        found.append((node, held[k][1]))

            same = False
            for _, ic, ib, jc, jb, role, comp, node, s in rows:
                same = (ic, ib) == (jc, jb)
                if role == 0:
                    held.append((comp, node, s))
                    continue
                if held:
                    block = block or _Block([x[2] for x in held])
                    ask(comp, node, s)
            if same and len(held) > 1:
                block = _Block([x[2] for x in held])
                for x in held:
                    ask(*x)
            yield _edges(found)

    return run


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, r1, r2, n_shingles, component_id, component) for every row of docs: two rows link when the Jaccard similarity of their sets of
    n-word shingles, A-Z lower-cased, is percent / 100 at least; component_id is the smallest id reachable. r1 and r2 are row_hashes; component
    tells components apart, even those of one component_id, and is null for a text without shingles. percent is 75 to 99.

    1. One pass hashes each text's set, and counts all tokens in a sketch, which orders them from rare to frequent. Rows with equal sets
       (two 64-bit hashes and the size) are one node from here on.
    2. A second pass makes the index: single tokens for rare ones, pairs of adjacent tokens for the frequent class (see keys_of, extended_lengths).
       It is shuffled once; keys of one set go. Keys that many sets share are salted.
    3. Contraction, which only saves work: under some of its keys each node meets others of the same key, in chunks of bounded
       size, and links found there merge nodes into components.
    4. Every two components that share a key are verified: members of the smaller meet the larger in blocks, and stop at the first
       link. Under a crowded key nothing is paired: its nodes meet in blocks of bounded size, where sizes allow a
       link; crowded keys whose components have the same least hash meet together. Links inside a component are not looked for, as they change no result; all others are found.

    Texts without words have no shingles and link with nothing, and so do null texts. A very long text is one set in a
    slice of its own. Repeated rows are linked like copies, and ties of ids give equal answers. A null id is never the smallest unless all ids of a component are null.
    An empty table gives an empty result. Other columns of docs, whatever their names, don't matter. Two linked sets that differ would
    be missed if their first hashes were equal (2^-64 a pair)."""
    if not 75 <= percent <= 99:
        raise ValueError("percent must be 75 to 99")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    least = -(-percent // (100 - percent))  # smaller sets link with equal sets only
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_hashes(id_col, F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    first = scratch.write(rows.mapInArrow(_profiles(n, to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, r1 long, r2 long, n long, h1 long, h2 long, slot int, part int, counts binary"))
    sketch = spark.sparkContext.broadcast(_sketch(first.where("slot IS NOT NULL").select("slot", "part", "counts")))
    profiles = first.where("slot IS NULL").select("doc_id", "r1", "r2", "n", "h1", "h2")
    same = ["h1", "h2", "n"]
    nodes = profiles.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min(F.struct("r1", "r2")).alias("row"), F.count("*").alias("copies"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()))

    index = rows.select("text").mapInArrow(_postings(n, percent, sketch, least), "key long, h1 long, salt int")
    under = Window.partitionBy("key", "salt")
    shared = index.withColumn("lo", F.min("h1").over(under)).withColumn("hi", F.max("h1").over(under)).where("lo <> hi OR salt > 0").select("key", "h1")
    shared = scratch.write(shared)
    index = scratch.write(shared.join(nodes.select("h1", "node", F.col("n").cast("int").alias("n")), "h1").select("key", "node", "n").distinct())
    scratch.drop(shared)
    sketch.destroy()
    member = scratch.write(index.groupBy("node").agg(F.max("n").alias("n"), *[F.min_by("key", F.xxhash64("key", F.lit(k))).alias(f"k{k}") for k in SEEDS]))
    wanted = nodes.join(member.select("node"), "node", "left_semi").select("row.*", "node")
    texts = scratch.write(rows.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).groupBy("node").agg(F.first("text").alias("text")))

    # contraction
    picks = member.select("node", F.inline(F.array(*[F.struct(F.lit(k).alias("seed"), F.col(f"k{k}").alias("key")) for k in SEEDS])))
    crowd = scratch.write(picks.groupBy("seed", "key").count().where("count >= IF(seed <= 2, 4, 16)"))
    place = ["seed", "key", "chunk"]
    near = join_groups(picks, crowd, ["seed", "key"], "count").withColumn("chunk", F.pmod(F.xxhash64("node", "seed"), F.ceil(F.col("count") / _CHUNK)))
    near = near.select(*place, "node").join(texts, "node").select(*place, "node", "text").repartition(*place).sortWithinPartitions(*place)
    links = scratch.write(near.mapInArrow(_contracted(percent, n), "a long, b long"))
    merged = components(links, scratch)

    # pairs of components
    comps = scratch.write(member.select("node", "n").join(merged, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp")))
    about = comps.groupBy("comp").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    held = scratch.write(index.join(comps.select("node", "comp"), "node").groupBy("key", "comp").agg(F.count("*").alias("nodes")))
    keys = scratch.write(held.groupBy("key").agg(F.count("*").alias("m"), F.sum("nodes").alias("nodes"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.bit_xor(F.xxhash64("comp")).alias("mark"), F.min(F.xxhash64("comp")).alias("label")).where("m > 1"))
    few = keys.where(F.col("m") <= CROWD).groupBy("m", "c1", "c2", "mark").agg(F.min("key").alias("key")).select("key")  # keys of the same components count once
    under = scratch.write(held.select("key", "comp").join(few, "key").join(about, "comp"))
    l, r = under.alias("l"), under.alias("r")
    small_first = "(l.size < r.size OR (l.size = r.size AND l.comp < r.comp))"
    pairs = l.join(r, "key").where(f"{small_first} AND 100 * l.hi >= {percent} * r.lo AND 100 * r.hi >= {percent} * l.lo")
    pairs = scratch.write(pairs.select(F.col("l.comp").alias("other"), F.col("r.comp").alias("comp"), F.ceil(F.col("r.size") / _CHUNK).alias("blks")).distinct())
    owns = comps.join(pairs.select("comp", "blks").distinct(), "comp").select("comp", F.pmod(F.xxhash64("node"), F.col("blks")).alias("blk"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("other"), "node")
    asking = pairs.join(comps.select(F.col("comp").alias("other"), "node"), "other").select("comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blks") - 1)).alias("blk"), F.lit(1).alias("role"), "other", "node")
    place = ["comp", "blk"]
    meet = owns.unionByName(asking).join(texts, "node").select(*place, "role", "other", "node", "text").repartition(*place).sortWithinPartitions(*place, "role", "other")
    more = scratch.write(meet.mapInArrow(_verified(percent, n), "a long, b long"))

    # crowded keys: blocks of the nodes that hold them, alike in size; a class of sizes is half a threshold wide, so linked sets are at most three classes apart
    dense = join_groups(index, keys.where(F.col("m") > CROWD).select("key", "label", "nodes"), ["key"], "nodes").select("label", "node", "n").distinct()
    dense = dense.join(comps.select("node", "comp"), "node").withColumn("c", F.floor(2 * F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))))
    dense = scratch.write(dense.select("label", "c", "comp", "node"))
    classes = dense.groupBy("label", "c").agg(F.count("*").alias("size"))
    classes = classes.groupBy("label").agg(F.collect_list(F.struct("c", F.ceil(F.col("size") / _CHUNK).alias("blks"))).alias("all"), F.sum("size").alias("size"))
    spread = join_groups(dense, scratch.write(classes), ["label"], "size").withColumn("blk", F.expr("struct(c, pmod(xxhash64(node), filter(all, x -> x.c = c)[0].blks) AS b)"))
    spread = spread.withColumn("o", F.explode(F.expr("flatten(transform(filter(all, x -> abs(x.c - c) <= 3), x -> transform(sequence(0L, x.blks - 1), b -> struct(x.c, b AS b))))")))
    spread = spread.select("label", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), (F.col("blk") > F.col("o")).cast("int").alias("role"), "comp", "node")
    spread = spread.select("label", F.col("i.c").alias("ic"), F.col("i.b").alias("ib"), F.col("j.c").alias("jc"), F.col("j.b").alias("jb"), "role", "comp", "node")
    place = ["label", "ic", "ib", "jc", "jb"]
    blocks = spread.join(texts, "node").select(*place, "role", "comp", "node", "text").repartition(*place).sortWithinPartitions(*place, "role")
    crossed = blocks.mapInArrow(_crossed(percent, n), "a long, b long")
    final = components(scratch.write(links.union(more).union(crossed)), scratch)

    named = scratch.write(nodes.join(final, "node", "left").select(*same, "least", "copies", F.coalesce("comp", "node").alias("component")))
    whole = scratch.write(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = scratch.write(join_groups(named, whole, ["component"], "members").select(*same, "copies", "component", "component_id"))
    some = join_groups(profiles, named, same, "copies").select("doc_id", "r1", "r2", "n", "component_id", "component")
    none = profiles.where("n = 0").select("doc_id", "r1", "r2", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    out = scratch.write(some.unionByName(none).select(F.col("doc_id").alias(id_col), "r1", "r2", F.col("n").alias("n_shingles"), "component_id", "component"))
    scratch.close(out)
    return out
