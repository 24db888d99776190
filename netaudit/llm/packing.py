"""Packing: concatenate and cut, by prefix sums over partition token totals."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netaudit.llm.common import materialize
from netaudit.llm.words import slices

LENGTH, END = 2048, 1
#: Words whose ids a task remembers, at most.
_REMEMBER = 1_000_000
#: Fixed value: how the byte-level tokenizer splits a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE, _AFTER = re.compile(r"\s "), re.compile(r" \s")


class Encoder:
    """Token ids of texts, as bytes of 32-bit integers. The tokenizer splits at a blank between two words before anything else, so the ids of
    a text are those of its words, each with the blank before it. Words are looked up first; new ones are encoded together
    in one run, by tiktoken over the same file's vocabulary, whose ids are the ranks of its merges, and parted again where an id begins with the
    blank. Texts with other white space beside a blank, or with a special token, are encoded as a whole by tokenizers itself.
    plain: the strings of special tokens are text like any other."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.width = 2 if len(self.blank) <= 1 << 16 else 4  # bytes that hold any id
        self.blank[[i for w, i in vocabulary.items() if w.startswith("\u0120")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if w not in self.special}
        self.ranks = ranks
        if plain:
            self.tokenizer.encode_special_tokens = True
            self.special = []
        self.fast = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def hard(self, text: str) -> bool:
        """Whether white space stands beside a blank or at either end, other than one blank at the start: there a word's ids hang on what stands beside it."""
        return not text or text[0].isspace() and text[0] != " " or text[-1].isspace() or bool(_BEFORE.search(text) or _AFTER.search(text)) or "\0" in text or any(s in text for s in self.special)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; those of special tokens are none."""
        out = [b""] * len(self.blank)
        for data, k in self.ranks.items():
            out[k] = data
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def parts(self, words: list[str]) -> list[bytes]:
        """The ids of each of some words that begin with a blank and hold no other."""
        ids = np.array(self.fast.encode_ordinary("".join(words)), "<u4")
        at = np.append(np.flatnonzero(self.blank[ids]), len(ids)) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of such words."""
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            self.known.update(zip(some, self.parts(some), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _REMEMBER:
            self.known.clear()
        parts = [None if self.hard(t) else t.replace(" ", "\0 ").split("\0") for t in texts]
        self.learn(list({w for p in parts if p for w in p[1:]}.difference(self.known)))
        for p in parts:
            if p and p[0] not in self.known:
                self.known[p[0]] = self.ids(p[0]).tobytes()
        get = self.known.__getitem__
        return [self.ids(t).tobytes() if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts, strict=True)]


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        width = max(encoder.width, 2 if end < 1 << 16 else 4)
        for whole in batches:
            for batch in slices(whole):
                ids = [x + tail for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                begins = at + np.append(0, np.cumsum(n)[:-1])
                at += int(n.sum())
                small = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(begins), pa.array(n), pa.array(small, pa.binary())], names=["doc_id", "part", "begins", "n", "ids"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, at, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                data, start = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, zlib.crc32(data[start : start + size].tobytes()), n, sequence, offset))
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all rows of docs in sequences of `length` tokens: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    First pass: each task encodes its rows, ends each with the id `end`, and writes the ids with their places in its own stream. The prefix
    sums of the tasks' totals, one number a task, make these places global. Second pass: fixed windows cut the one
    stream; a row that crosses a boundary leaves a piece on either side. Only the last sequence can be short; it is padded. The ids
    are written once and read once, so both passes see the same order, also when a task is repeated.

    Null and empty texts are the end id alone. Repeated rows and ids are packed one by one. A very long text is encoded whole and cut into as many
    pieces as it takes. Ids take 16 bits each where all of the vocabulary fit, and 32 otherwise. An empty table gives no piece. Other columns don't matter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = materialize(rows.mapInArrow(_encoded(tokenizer, end), "doc_id long, part long, begins long, n long, ids binary"))
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = coded.join(F.broadcast(before), "part").select("doc_id", "n", (F.col("before") + F.col("begins")).alias("at"), "ids")
    return placed.mapInArrow(_cut(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
