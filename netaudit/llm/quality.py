"""Quality classifier: naive Bayes support vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netaudit.llm.common import free, quoted
from netaudit.llm.words import mixed, raw, slices, word_hashes

_U = np.uint64
#: Bits of a feature; labelled rows to learn from, at most about; the hinge loss's weight; sweeps over the rows.
BITS, LEARN_DOCS, COST, SWEEPS = 18, 8000, 1.0, 8
#: Features of the rows to learn from, at most about: the sample ends where it reaches so many, which bounds the memory of the one task.
LEARN_FEATURES = 50_000_000


@dataclass(frozen=True)
class Model:
    """weights of the features, scaled by the log-count ratios; bias; slope and shift of the sigmoid that makes margins scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, features): for each text its distinct n-grams as sorted hashes of BITS bits: runs of three bytes with digits alike, and
    words and pairs of words, A-Z lower-cased."""
    data, ends = raw(texts)
    data = np.where((data >= 48) & (data <= 57), 48, data).astype(_U)
    words, woff = word_hashes(texts)
    m = max(0, len(data) - 2)
    three = mixed((data[:m] << _U(16) | data[1 : m + 1] << _U(8) | data[2 : m + 2]) + _U(1 << 40)) if m else np.zeros(0, _U)
    two = mixed(words[:-1] * _U(3) + words[1:]) if len(words) > 1 else np.zeros(0, _U)
    shift, out = _U(64 - BITS), []
    for a, b, c, d in zip(ends[:-1], ends[1:], woff[:-1], woff[1:], strict=True):
        own = np.concatenate([three[a : max(a, b - 2)], words[c:d], two[c : max(c, d - 1)]]) >> shift
        out.append(np.unique(own.astype(np.int32)))
    return np.append(0, np.cumsum([len(x) for x in out])), np.concatenate(out) if out else np.zeros(0, np.int32)


def fit(offsets: np.ndarray, found: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """A linear hinge-loss model on indicators scaled by log-count ratios and brought to unit length, by dual coordinate descent; every
    fifth row is kept for the sigmoid."""
    rows, y = len(labels), np.where(labels == 1, 1.0, -1.0)
    tune = np.arange(rows) % 5 == 4
    learn = np.flatnonzero(~tune) if tune.any() and len(set(y[~tune])) > 1 else np.arange(rows)
    row = [found[offsets[i] : offsets[i + 1]] for i in range(rows)]
    counts = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for i in learn:
        counts[int(y[i] < 0)][row[i]] += 1
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    length = np.array([np.sqrt(np.sum(ratio[r] ** 2)) + 1e-9 for r in row])
    w, b, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(rows), np.random.default_rng(seed)
    cost = np.where(y > 0, COST * max(1, (y < 0).sum()) / max(1, (y > 0).sum()), COST)  # either class weighs the same
    for _ in range(SWEEPS):
        for i in rng.permutation(learn):
            x = ratio[row[i]] / length[i]
            gradient = y[i] * (x @ w[row[i]] + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # x and the bias have unit length each
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[row[i]] += step * x
                b += step
                alpha[i] = new
    margin = np.array([(ratio[r] / n) @ w[r] + b for r, n in zip(row, length, strict=True)])
    use = tune if tune.any() and len(set(y[tune])) > 1 else np.ones(rows, bool)
    t, z = (labels[use] == 1).astype(float), margin[use]
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([np.sum((p - t) * z) + 0.01 * (slope - 1), np.sum(p - t) + 0.01 * shift])
        v = p * (1 - p)
        h = np.array([[np.sum(v * z * z) + 0.01, np.sum(v * z)], [np.sum(v * z), np.sum(v) + 0.01]])
        move = np.linalg.solve(h, g)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return Model(np.stack([w * ratio, ratio * ratio]).astype(np.float32), b, max(float(slope), 1e-3), float(shift))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    offsets, found, labels = [np.zeros(1, np.int64)], [], []
    for whole in batches:
        for batch in slices(whole):
            if offsets[-1][-1] > LEARN_FEATURES:
                break
            o, f = features(batch.column("text"))
            offsets.append(o[1:] + offsets[-1][-1])
            found.append(f)
            labels.append(np.asarray(batch.column("label")))
    if labels and len(set(np.concatenate(labels))) > 1:
        m = fit(np.concatenate(offsets), np.concatenate(found), np.concatenate(labels))
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "bias": m.bias, "slope": m.slope, "shift": m.shift}])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_docs: int = LEARN_DOCS) -> Model | None:
    """Fits on about `learn_docs` of the labelled rows, chosen by a hash of the id, in one task; that bound also holds for the ids that are broadcast. None unless both labels occur. Labels other than 0 and 1
    and null ids are left out; a repeated label of an id counts once. Other columns of docs and labels don't matter, whatever their names."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    share = min(1.0, learn_docs / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = docs.select(F.col(*quoted([id_col])).alias("_id"), F.coalesce(F.col(*quoted([text_col])), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marks), "_id").select("_id", "text", F.col("label").cast("long").alias("label"))
    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "text").select("text", "label").mapInArrow(_fitted, "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(got[0][0], np.float32).reshape(2, -1), *got[0][1:]) if got else None


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for whole in batches:
            for batch in slices(whole):
                if m is None:
                    score = np.full(batch.num_rows, 0.5)
                else:
                    offsets, found = features(batch.column("text"))
                    sums = [np.append(0.0, np.cumsum(w[found], dtype=np.float64)) for w in m.weights]
                    margin = (sums[0][offsets[1:]] - sums[0][offsets[:-1]]) / (np.sqrt(np.maximum(sums[1][offsets[1:]] - sums[1][offsets[:-1]], 0)) + 1e-9) + m.bias
                    score = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns (not the text) of every row of docs with score, the chance of label 1: 0 to 1, also for empty and null texts, which have no
    n-gram and get the bias's score. Without a model every score is 0.5. Very long texts are scored whole. Rows are scored one by one, so repeated
    rows get equal scores, and an empty table gives an empty result. If score is among the columns, the added one is _score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*quoted(columns)).alias("row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scored(shared), StructType([rows.schema["row"], *StructType.fromDDL("score double")]))
    return out.select("row.*", F.col("score").alias(*free(docs.select(*quoted(columns)), "score")))
