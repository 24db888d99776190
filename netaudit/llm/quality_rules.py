"""Quality rules: counted rules of the contract and compression bands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netaudit.llm.common import free, quoted, WORD
from netaudit.llm.words import slices

CHUNK, LEVEL = 4096, 3
#: (bytes from, least ratio, greatest ratio) of whole texts. Short texts hardly compress, so only long ones have a lower limit:
#: above what random letters and digits give (at most 1.27 up to 1000 bytes, 1.33 up to 5000, 1.35 beyond), below prose.
BANDS = ((0, 0.0, 2.4), (200, 1.0, 2.6), (500, 1.28, 3.0), (1000, 1.4, 3.5), (5000, 1.4, 4.0), (20000, 1.4, 5.0))
#: The same of chunks, and the share of chunks out of their band that rejects a text.
CHUNK_BAND, CHUNK_SHARE = (1.4, 4.0), 0.5
ADDED = {c: "long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": "boolean", "kept": "boolean", "ratio": "double", "odd_chunks": "double"}
_WORD, _SYMBOL = re.compile(WORD), re.compile(r"[#*$%&|<>]")


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = list(zip(*(words[k:] for k in range(5)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        code: dict[tuple, int] = {}
        ids = np.array([code.setdefault(w, len(code)) for w in windows])
        twice = np.bincount(ids)[ids] > 1
        covered = np.zeros(len(words), bool)
        for k in range(5):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def bands(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(whole ratio, share of chunks out of band, within the limits) of a text's bytes. Texts up to a chunk have no chunks; the last chunk
    of longer ones is their final 4096 bytes, so that each byte lies in a full chunk."""
    if not data:
        return 1.0, 0.0, True
    ratio = len(data) / len(packer.compress(data))
    _, low, high = max(b for b in BANDS if b[0] <= len(data))
    chunks = [data[i : i + CHUNK] for i in range(0, len(data) - CHUNK + 1, CHUNK)] if len(data) > CHUNK else []
    if chunks and len(data) % CHUNK:
        chunks.append(data[-CHUNK:])
    odd = sum(not CHUNK_BAND[0] <= len(c) / len(packer.compress(c)) <= CHUNK_BAND[1] for c in chunks) / max(1, len(chunks))
    return ratio, odd, low <= ratio <= high and odd < CHUNK_SHARE


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for whole in batches:
        for batch in slices(whole):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = np.array([counts(t) for t in texts], np.int64).reshape(-1, 5)
            band = [bands(t.encode(), packer) for t in texts]
            failed = (got[:, 0] < 10) | (100 * got[:, 4] > 20 * got[:, 0])
            kept = ~failed & np.array([b[2] for b in band], bool)
            arrays = [batch.column("row"), *[pa.array(got[:, k]) for k in range(5)], pa.array(failed), pa.array(kept), pa.array([b[0] for b in band], pa.float64()), pa.array([b[1] for b in band], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *ADDED])


def quality_rules(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns (not the text) of every row of docs with its counts, base_failed, kept, ratio and odd_chunks; where docs has a column of
    that name among them, the added one has an underscore before it. Null texts count as empty: no words, so base_failed. Very long texts are judged
    whole and chunk by chunk. Rows are judged one by one, so repeated rows get equal answers, and an empty table gives an empty result."""
    rows = docs.select(F.struct(*quoted(columns)).alias("row"), F.col(text_col).alias("text"))
    types = ", ".join(f"{c} {t}" for c, t in ADDED.items())
    out = rows.mapInArrow(_judged, StructType([rows.schema["row"], *StructType.fromDDL(types)]))
    return out.select("row.*", *[F.col(c).alias(n) for c, n in zip(ADDED, free(docs.select(*quoted(columns)), *ADDED), strict=True)])
