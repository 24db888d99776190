"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netaudit.llm.common import free, quoted
from netaudit.llm.words import mixed, raw, slices

_U = np.uint64
#: Bytes of an n-gram; bits of a position in the filter; hash functions; labelled rows to learn from, at most about.
SIZES, BITS, HASHES, LEARN_DOCS, _SLOT = (3, 4, 5), 20, 3, 8000, 1 << 16
#: Bytes of text that a task works on at once; its arrays hold some hundred times as many.
_BYTES = 1 << 18
#: Languages, at most; the filter takes 8 MB for each 64.
MOST_LANGS = 1024
#: A language contains an n-gram that stands in two of its rows at least, and as often a row as this part of where it is most frequent.
SHARE = 0.05
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    """langs; masks[w, i]: bit l of word w says that language 64 * w + l set position i; false_positive[l]: the chance that an n-gram
    seen nowhere looks contained in language l."""

    langs: tuple[str, ...]
    masks: np.ndarray
    false_positive: np.ndarray


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all n-grams of a column: bytes of UTF-8, A-Z lower-cased, other ASCII as blanks, runs of blanks as one, one
    blank at either end. No n-gram crosses from text to text."""
    data, offsets = raw(texts)
    size = np.diff(offsets) + 2
    at = np.append(0, np.cumsum(size))
    line = np.full(at[-1], 32, np.uint8)
    line[np.arange(len(data)) + np.repeat(2 * np.arange(len(size)) + 1, np.diff(offsets))] = _FOLD[data]
    row = np.repeat(np.arange(len(size)), size)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 32) | (line[:-1] != 32) | (row[1:] != row[:-1])
    line, row = line[keep].astype(_U), row[keep]
    hashes, rows = [], []
    for n in SIZES:
        m = max(0, len(line) - n + 1)
        value = np.zeros(m, _U)
        for k in range(n):
            value = value << _U(8) | line[k : k + m]
        inside = row[:m] == row[n - 1 :][:m] if m else np.zeros(0, bool)
        hashes.append(mixed(value[inside] * _U(8) + _U(n % 8)))
        rows.append(row[:m][inside])
    return np.concatenate(hashes), np.concatenate(rows)


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((hashes >> _U(k * 21)) & _U((1 << BITS) - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, rows): in how many rows of the batch each n-gram of a language stands."""
    for whole in batches:
        for batch in slices(whole, chunk=_BYTES):
            h, row = grams(batch.column("text"))
            names, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            for k, name in enumerate(names):
                found, n = np.unique(h[once & (codes[row] == k)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, bits = np.asarray(b.column("gram")).view(_U), b.column("bits")
        for at in _places(h):
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("word"), bits], names=["at", "word", "bits"])


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, word, masks): runs of the filter's positions, packed, so that few bytes go to the driver."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        slot, word, at, bits = (np.asarray(b.column(c)) for c in ("slot", "word", "at", "bits"))
        for key in set(zip(slot.tolist(), word.tolist(), strict=True)):
            own = (slot == key[0]) & (word == key[1])
            found.setdefault(key, np.zeros(_SLOT, _U))[at[own] - key[0] * _SLOT] |= bits[own].view(_U)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1) for v in found.values()], pa.binary())], names=["slot", "word", "masks"])


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", learn_docs: int = LEARN_DOCS) -> Model:
    """Fits the filters on about `learn_docs` of the labelled rows, chosen by a hash of the text; all of them if there are fewer."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    share = min(1.0, learn_docs / max(1, rows.select("lang").count()))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages: the filter is made for {MOST_LANGS} at most")
    words = max(1, -(-len(langs) // 64))
    masks = np.zeros((words, 1 << BITS), _U)
    if langs:
        rank = rows.sparkSession.createDataFrame([(x, k // 64, int(np.uint64(1 << k % 64).view(np.int64)), float(sizes[x])) for k, x in enumerate(langs)], "lang string, word int, bit long, size double")
        counts = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 2")
        rated = counts.join(F.broadcast(rank), "lang").withColumn("rate", F.col("n") / F.col("size"))
        best = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("word", "bit", "rate")).alias("all"))
        owned = best.select("gram", "most", F.explode("all").alias("x")).where(F.col("x.rate") >= SHARE * F.col("most"))
        bits = owned.groupBy("gram", F.col("x.word").alias("word")).agg(F.bit_or("x.bit").alias("bits"))
        at = bits.mapInArrow(_set_bits, "at long, word int, bits long").groupBy("at", "word").agg(F.bit_or("bits").alias("bits"))
        parts = at.withColumn("slot", F.floor(F.col("at") / _SLOT)).repartition((1 << BITS) // _SLOT, "slot", "word").mapInArrow(_filters, "slot long, word int, masks binary")
        for slot, word, data in parts.collect():
            masks[word, slot * _SLOT : (slot + 1) * _SLOT] = np.frombuffer(zstandard.decompress(data), _U)
    filled = np.array([float(np.mean(masks[k // 64] >> _U(k % 64) & _U(1))) for k in range(len(langs))])
    return Model(langs, masks.astype(np.uint8) if len(langs) <= 8 else masks, filled**HASHES)


def _decided(model, at: int | None):
    """The text is the column of that name, or the field at that place of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for given in batches:
            whole = given if at is None else given.append_column("text", pc.struct_field(given.column("row"), at))
            for batch in slices(whole, chunk=_BYTES):
                h, row = grams(batch.column("text"))
                total = np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
                share = np.zeros((batch.num_rows, max(1, len(m.langs))))
                for w, mask in enumerate(m.masks):
                    held = np.full(len(h), np.iinfo(mask.dtype).max, mask.dtype)
                    for place in _places(h):
                        held &= mask[place]
                    for k in range(64 * w, min(64 * w + 64, len(m.langs))):
                        hits = np.bincount(row[(held >> held.dtype.type(k - 64 * w) & held.dtype.type(1)).astype(bool)], minlength=batch.num_rows)
                        share[:, k] = (hits / total - m.false_positive[k]) / (1 - m.false_positive[k])
                best = share.argmax(axis=1)
                known = np.asarray(batch.column("letters").fill_null(False)) & bool(m.langs)
                score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
                named = [m.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(named, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns of every row of docs, with lang_pred and score; if the columns hold such a name, the added one has an underscore before it.

    For each n-gram of a text the filter gives at once the bitmask of all languages that contain it. Counting each language's bits and taking
    away what the filter's fill lets through by chance gives the share of the text's n-grams in each language: the largest
    decides, the first by name among equals, and is the score. A text without a letter, and a null text, is `und` with score 0; so is every
    text if nothing was learned. Very long texts are read whole. Rows are judged one by one, so repeated rows and ids get equal answers, and
    an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = columns.index(text_col) if text_col in columns else None
    rows = docs.select(F.struct(*quoted(columns)).alias("row"), *([F.col(text_col).alias("text")] if at is None else []), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    out = rows.mapInArrow(_decided(shared, at), StructType([rows.schema["row"], *StructType.fromDDL("lang_pred string, score double")]))
    return out.select("row.*", *[F.col(c).alias(n) for c, n in zip(("lang_pred", "score"), free(docs.select(*quoted(columns)), "lang_pred", "score"), strict=True)])


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
