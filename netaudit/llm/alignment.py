"""Alignment of two tokenizers' tokens over one text, by a galloping intersection of their end offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netaudit.llm.common import Scratch
from netaudit.llm.packing import Encoder
from netaudit.llm.words import slices

#: Words whose tokens a task remembers, and pairs whose counts it holds back, at most. Neither changes a result.
_REMEMBER, _HELD = 1 << 18, 1 << 20
#: Pairs of a slice of the counts, and bytes of links that meet one copy of a slice.
SLICE, PART = 1 << 20, 1 << 26
_SPACE = "▁"


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of short the number of smaller values in long; both ascend. All values search at once: each starts at its
    proportional place in long, doubles its step until the value is bracketed, and halves the bracket."""
    n = len(long)
    if not len(short) or not n:
        return np.zeros(len(short), np.int64)
    at = np.arange(len(short), dtype=np.int64) * n // len(short)
    up = long[at] < short
    lo, hi = np.where(up, at, at - 1), np.where(up, at + 1, at)
    todo, step = np.flatnonzero(up), 1
    while len(todo := todo[hi[todo] < n]) and len(todo := todo[long[hi[todo]] < short[todo]]):
        lo[todo] = hi[todo]
        step *= 2
        hi[todo] = np.minimum(hi[todo] + step, n)
    todo, step = np.flatnonzero(~up), 1
    while len(todo := todo[lo[todo] >= 0]) and len(todo := todo[long[lo[todo]] >= short[todo]]):
        hi[todo] = lo[todo]
        step *= 2
        lo[todo] = np.maximum(lo[todo] - step, -1)
    while len(todo := np.flatnonzero(hi - lo > 1)):
        middle = (lo[todo] + hi[todo]) // 2
        less = long[middle] < short[todo]
        lo[todo[less]] = middle[less]
        hi[todo[~less]] = middle[~less]
    return hi


def align_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a_cuts, b_cuts, i, j) of the ascending end offsets a and b of two tokenizations of one text: the numbers of tokens up to each common
    end, which cut the tokens into groups, and all pairs (i, j) of tokens whose ranges overlap."""
    if len(a) > len(b):
        b_cuts, a_cuts, j, i = align_ends(b, a)
        return a_cuts, b_cuts, i, j
    rank = gallop(a, b)
    common = b[np.minimum(rank, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
    first = np.append(0, (rank + common)[:-1])  # of the other list's tokens, the first that ends after this token begins
    n = rank - first + 1  # and rank is the one that reaches this token's end
    i = np.repeat(np.arange(len(a)), n)
    j = np.arange(len(i)) + np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n)
    return np.flatnonzero(common) + 1, rank[common] + 1, i, j


class Tokens:
    """Ids and end offsets of texts, with a space before each, in a byte-level BPE (A, a file of tokenizers) and a piece model (B, of sentencepiece).

    Both split before a blank between two words, so the tokens of such words are worked out once and remembered. That holds for A by its
    pattern, and for B if none of its pieces has a space past its start but those of spaces alone, which is looked up. Texts with
    other white space beside a blank are encoded as a whole."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(a_path, plain=True)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.parts = all(_SPACE not in p[1:] or not p.strip(_SPACE) for p in pieces)
        bytes_of = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.b_bytes, self.a_bytes = bytes_of, self.a.token_bytes()
        self.b_sizes, self.a_sizes = np.array([len(x) for x in self.b_bytes]), np.array([len(x) for x in self.a_bytes])
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        whole = text.encode()
        return b"".join([self.a_bytes[k] for k in a.tolist()]) == whole == b"".join([self.b_bytes[k] for k in b.tolist()])

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """text with its space; null where the tokens are not the text."""
        a, b = self.a.ids(text), np.array(self.b.encode(text[1:]), "<u4")
        return (a, b) if self._same(text, a, b) else None

    def _learn(self, words: list[str]) -> None:
        """Words with their blank, many at once. A word of whose bytes the tokens are not is remembered as null."""
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            a = self.a.parts(some)
            lists = self.b.encode([w[1:] for w in some], num_threads=1)
            flat = list(chain.from_iterable(lists))
            ends, data = (4 * np.cumsum([len(x) for x in lists])).tolist(), np.array(flat, "<u4").tobytes()
            b = [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            whole, a_flat = "".join(some).encode(), np.frombuffer(b"".join(a), "<u4").tolist()
            if b"".join(map(self.a_bytes.__getitem__, a_flat)) == whole == b"".join(map(self.b_bytes.__getitem__, flat)):
                self.known.update(zip(some, zip(a, b, strict=True), strict=True))
            else:
                same = (self._same(w, np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for w, x, y in zip(some, a, b, strict=True))
                self.known.update((w, (x, y) if ok else None) for w, x, y, ok in zip(some, a, b, same, strict=True))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids in A and in B of each text; null for an empty text and one that the tokens are not."""
        if len(self.known) > _REMEMBER:
            self.known.clear()
        spaced = [" " + t for t in texts]
        parts = [t.replace(" ", "\0 ").split("\0")[1:] if len(t) > 1 and self.parts and not self.a.hard(t) else None for t in spaced]
        self._learn(list({w for p in parts if p for w in p}.difference(self.known)))
        out: list = []
        for t, p in zip(spaced, parts, strict=True):
            found = list(map(self.known.__getitem__, p)) if p else [None]
            if len(t) == 1:
                out.append(None)
            elif None in found:
                out.append(self._whole(t))
            else:
                out.append(tuple(np.frombuffer(b"".join([x[k] for x in found]), "<u4") for k in (0, 1)))
        return out


def _named(n: int, marks: str) -> list[np.ndarray]:
    """For each mark the decimal ids, each with the mark after it."""
    return [np.array([f"{k}{m}" for k in range(n)], object) for m in marks]


def _written(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, a_names: list, b_names: list) -> str:
    """Groups as text: a1,a2|b1;a3|b2,b3."""
    out = np.empty(len(a) + len(b), object)
    for ids, cuts, names, before in ((a, a_cuts, a_names, np.append(0, b_cuts[:-1])), (b, b_cuts, b_names, a_cuts)):
        text = names[0][ids]
        text[cuts - 1] = names[1][ids[cuts - 1]]
        out[np.arange(len(ids)) + np.repeat(before, np.diff(cuts, prepend=0))] = text
    return "".join(out.tolist())[:-1]


def _counted(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, place = np.unique(pairs, return_inverse=True)
    return values, np.bincount(place, n, len(values)).astype(np.int64)


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pair", "docs"]


def _aligned(a_path: str, b_path: str, digest: bool, id_type: pa.DataType):
    """Rows of documents, with their distinct linked id pairs as bytes (pairs, then how often each), and rows (pair, docs) of a task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(a_path, b_path)
        width = len(tokens.b_bytes)
        a_names, b_names = _named(len(tokens.a_bytes), ",|"), _named(width, ",;")
        held, n_held = [], 0

        def counts() -> pa.RecordBatch:
            pairs = np.concatenate(held) if held else np.zeros(0, np.int64)
            pair, docs = _counted(pairs, np.ones(len(pairs)))
            nothing = [pa.nulls(len(pair), id_type), *[pa.nulls(len(pair), pa.int64())] * 4, pa.nulls(len(pair), pa.string()), pa.nulls(len(pair), pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(pair), pa.array(docs)], names=_NAMES)

        for whole in batches:
            for batch in slices(whole):
                rows = []
                for ids in tokens.encode([t or "" for t in batch.column("text").to_pylist()]):
                    if ids is None:
                        rows.append((0, 0, 0, 0, "", b""))
                        continue
                    a, b = ids
                    a_cuts, b_cuts, i, j = align_ends(np.cumsum(tokens.a_sizes[a]), np.cumsum(tokens.b_sizes[b]))
                    text = _written(a, b, a_cuts, b_cuts, a_names, b_names)
                    pair, times = np.unique(a[i].astype(np.int64) * width + b[j], return_counts=True)
                    held.append(pair)
                    n_held += len(pair)
                    rows.append((len(a), len(b), len(a_cuts), len(i), hashlib.sha256(text.encode()).hexdigest() if digest else text, pair.tobytes() + times.astype(np.int64).tobytes()))
                k, columns = len(rows), list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=_NAMES)
                if n_held > _HELD:
                    yield counts()
                    held, n_held = [], 0
        yield counts()

    return run


def _split(parts: int):
    """Rows (row, links) to rows (row, slice, pairs, times): one for each slice that holds any of a row's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "links"):
                out = []
                for row, links in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist(), strict=True):
                    pair, times = np.frombuffer(links, np.int64).reshape(2, -1)
                    at = pair % parts
                    for k in np.unique(at).tolist():
                        out.append((row, k, pair[at == k].tobytes(), times[at == k].tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row", "slice", "pairs", "times"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (slice, salt): first the counts of that slice, by pair (role 0), then rows with pairs of it (role 1), which get their sums."""
    at, table, counts = None, [], None
    for whole in batches:
        for batch in slices(whole, "pairs"):
            key = batch.column("slice").to_numpy(), batch.column("salt").to_numpy()
            ends = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1
            out = []
            for lo, hi in zip(np.append(0, ends).tolist(), np.append(ends, batch.num_rows).tolist(), strict=True):
                if at != (mark := (int(key[0][lo]), int(key[1][lo]))):
                    at, table, counts = mark, [], None
                run = batch.slice(lo, hi - lo)
                zero = int(np.sum(run.column("role").to_numpy() == 0))
                if zero:
                    table.append([run.slice(0, zero).column(c).to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best")])
                if zero < run.num_rows:
                    counts = counts or [np.concatenate(c) for c in zip(*table, strict=True)]
                    run = run.slice(zero)
                    pairs, times = (run.column(c).to_pylist() for c in ("pairs", "times"))
                    n = np.array([len(p) // 8 for p in pairs])
                    place, times = np.searchsorted(counts[0], np.frombuffer(b"".join(pairs), np.int64)), np.frombuffer(b"".join(times), np.int64)
                    first = np.append(0, np.cumsum(n)[:-1])
                    out.append((run.column("row").to_numpy(), np.add.reduceat(counts[1][place] * times, first), np.add.reduceat(counts[2][place] * times, first)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["row", "count_sum", "n_best"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, slice_pairs: int = SLICE, part_bytes: int = PART) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row for every row of docs: how the tokens of space + text in the byte-level BPE of a_path
    (A) and in the piece model of b_path (B) lie to each other. groups are `a1,a2|b1;a3|b2,b3`, cut where tokens of both end, or their SHA-256 with digest.
    Links are all pairs of tokens whose byte ranges overlap; an id pair's count is the number of rows that hold it linked, n_best the number of links whose count is
    the highest of their A id, count_sum the sum over links.

    1. Each task encodes its texts and intersects the end lists by galloping; differences of ranks give each token's overlaps. Rows keep their distinct
       pairs; the task's counts of pairs go along. Written once.
    2. Counts are added up, one row a pair, and the highest of each A id marked; an A id has no more pairs than B has ids.
    3. Counts are parted into slices of bounded size, and rows' pairs with them. A slice meets its pairs in parts of bounded size, each with its own
       copy of the slice, so neither a common pair nor a large vocabulary of pairs lands in one task, and nothing is broadcast.

    Null and empty texts, and texts that the tokens of A or B do not spell (those with U+2581), have no tokens: zeros and empty groups. Special
    tokens' strings are plain text. A very long text is one row, encoded and aligned as a whole. Repeated rows and ids count one by one, ties for the highest
    all count, an empty table gives an empty result, and other columns of docs don't matter, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pair long, docs long"
    coded = rows.mapInArrow(_aligned(a_path, b_path, digest, to_arrow_type(id_type)), schema)
    coded = scratch.write(coded.withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.write(coded.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs")))
    width = _pieces(b_path)
    top = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("top"))
    counts = scratch.write(counts.withColumn("a", F.expr(f"pair div {width}")).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).cast("long").alias("best")))
    linked = coded.where("length(links) > 0").select("row", "links")
    n_bytes = linked.agg(F.sum(F.length("links"))).first()[0] or 0
    parts = -(-counts.count() // slice_pairs) | 1
    salts = max(1, -(-n_bytes // (parts * part_bytes)))
    table = counts.select((F.col("pair") % parts).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("role"), "pair", "docs", "best")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("pairs", "binary"), ("times", "binary"))]
    some = linked.mapInArrow(_split(parts), "row long, slice long, pairs binary, times binary")
    some = some.select("slice", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("role"), *[F.lit(None).cast("long").alias(c) for c in ("pair", "docs", "best")], "row", "pairs", "times")
    place = ["slice", "salt"]
    meet = table.select("*", *nothing).unionByName(some).repartition(*place).sortWithinPartitions(*place, "role", "pair")
    sums = meet.mapInArrow(_scored, "row long, count_sum long, n_best long").groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = coded.where("pair IS NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row", "left")
    out = scratch.write(out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups"))
    scratch.close(out)
    return out


def _pieces(b_path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=b_path))
