"""Word and shingle hashes of whole Arrow columns at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_PLACES = np.random.default_rng(20240229).integers(0, 2**63, 4096, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(batch: pa.RecordBatch, column: str = "text", chunk: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about a megabyte of text each, or of so many bytes, so that work arrays stay small whatever the texts' lengths."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + chunk, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, one after the other, and where each text begins and the last ends; null is empty."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word, A-Z lower-cased, and the offsets of each text's words."""
    data, offsets = raw(texts)
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = (_LOW[data[at]].astype(_U) + _U(1)) * _PLACES[place & 4095]
    if place.max() > 4095:
        value *= (place >> 12).astype(_U) * _U(2) + _U(1)
    return mixed(np.add.reduceat(value, first) + lengths.astype(_U)), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its set of n-word shingles as sorted 64-bit hashes: a text of fewer words has its whole sequence as
    the only one, a text without words none."""
    salt = mixed(np.arange(1, n + 1, dtype=_U))
    total = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n):
        total += words[k : k + len(total)] * (salt[k] | _U(1))
    total = mixed(total + _U(n))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            yield np.unique(total[a : b - n + 1])
        elif b > a:
            yield mixed(np.array([np.sum(words[a:b] * (salt[: b - a] | _U(1))) + _U(b - a)], _U))
        else:
            yield np.zeros(0, _U)
