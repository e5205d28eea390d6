"""Quality by Naive Bayes support vectors on n-gram indicators.

Indicators are hashed byte 4-grams, word uni- and bigrams, and n-grams of word
shapes (case, marks, digits, repetition). The classes' log-count ratios come
from the labelled training rows; they scale the indicators of a linear
model with squared hinge loss, fitted by dual coordinate descent. Its weights
are then drawn towards their mean size, as the method has it, and the margins
scaled to chances.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelmill.llm import kernels as K
from panelmill.llm.linear import labelled_sample, platt, sigmoid

BITS = 18
#: Labelled rows that the model is fitted on.
SAMPLE_ROWS = 8_000
#: Share of each weight that stays; the rest goes to the mean size of all.
INTERPOLATION = 0.25
COST = 1.0
EPOCHS = 12
_SHIFT = np.uint64(64 - BITS)
_CLASS = np.zeros(256, np.uint64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()"]] = 4
_CLASS[[ord(c) for c in "!"]] = 5
_CLASS[0x80:] = 6
_CLASS[[i for i in range(33, 128) if not _CLASS[i]]] = 7
_STEP = 1 << 21


def _features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per row the sorted different features."""
    starts, ends = K.word_spans(raw, offsets)
    hashes = K.span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)
    pairs = K.ngrams(hashes, 2, stream=7)
    head, tail = _CLASS[raw[starts]], _CLASS[raw[ends - 1]]
    second = _CLASS[raw[np.minimum(starts + 1, ends - 1)]]
    before = _CLASS[raw[np.maximum(ends - 2, starts)]]
    same = np.zeros(len(hashes), np.uint64)
    same[1:] = hashes[1:] == hashes[:-1]
    shape = (((head * np.uint64(8) + second) * np.uint64(8) + before) * np.uint64(8) + tail) * np.uint64(2) + same
    shapes = [K.ngrams(shape, n, stream=8 + n) for n in (1, 2, 3)]
    wide = raw.astype(np.uint32)
    quads = (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24) if len(raw) > 3 else wide[:0]
    quads = (quads.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        parts = [hashes[a:b], pairs[a : max(a, b - 1)], *(s[a : max(a, b - n)] for n, s in enumerate(shapes)), quads[offsets[i] : max(offsets[i], offsets[i + 1] - 3)]]
        yield np.unique((np.concatenate(parts) >> _SHIFT).astype(np.int32))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Features of each text, in slices of bounded size; an empty text has none."""
    raw, offsets = K.text_bytes(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _STEP, side="right")) - 1)
        yield from _features(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        size = np.sqrt(max(1, len(found)))
        return float(sigmoid(np.float64(self.slope * (self.weights[found].sum() / size + self.bias) + self.offset)))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised squared hinge loss.

    A row has the values ``scale`` at its indices, divided by the square root of their number.
    """
    dims = len(scale)

    def values(i: int) -> np.ndarray:
        return scale[rows[i]] / np.sqrt(max(1, len(rows[i])))

    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    # The rarer class weighs as much as the other one.
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    diagonal = 0.5 / (cost * weight)
    norms = np.array([float(v @ v) + 1.0 for v in map(values, range(len(y)))]) + diagonal
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            own = values(i)
            gradient = sign[i] * (w[rows[i]] @ own + bias) - 1 + diagonal[i] * alpha[i]
            projected = gradient if alpha[i] > 0 else min(gradient, 0.0)
            if projected:
                before = alpha[i]
                alpha[i] = max(0.0, before - gradient / norms[i])
                step = (alpha[i] - before) * sign[i]
                w[rows[i]] += step * own
                bias += step
                most = max(most, abs(projected))
        if most < 0.01:
            break
    return w, bias


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [f.astype("<i4").tobytes() for f in features(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["features", "y"])


def _unpacked(chunk: pa.Array) -> list[np.ndarray]:
    """The rows of a binary Arrow array as indices, without copies."""
    offsets = np.frombuffer(chunk.buffers()[1], "<i4")[chunk.offset : chunk.offset + len(chunk) + 1] // 4
    data = np.frombuffer(chunk.buffers()[2], "<i4") if chunk.buffers()[2] is not None else np.zeros(0, "<i4")
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most 2 * ``sample_rows`` (about ``sample_rows``) labelled training rows.

    Without rows of both classes every score is the share of the class that is there (0.5 without rows).
    """
    sample = labelled_sample(docs, labels, key, text, label, train, sample_rows)
    got = sample.mapInArrow(_rows, "features binary, y int").toArrow()
    y = np.array(got.column("y").to_pylist(), int)
    rows = [r for chunk in got.column("features").chunks for r in _unpacked(chunk)]
    dims = 1 << BITS
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(dims, np.float32), 0.0, 0.0, 8.0 * (share - 0.5))
    counts = np.ones((2, dims))
    for f, c in zip(rows, y.tolist(), strict=True):
        counts[c][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Features of single rows say nothing about others.
    ratio[counts.sum(axis=0) < 5] = 0
    w, bias = dual_coordinate_descent(rows, ratio, y, COST, EPOCHS)
    used = counts.sum(axis=0) >= 5
    w = np.where(used, (1 - INTERPOLATION) * np.abs(w[used]).mean() + INTERPOLATION * w, 0.0)
    weights = (w * ratio).astype(np.float32)
    margins = np.array([weights[f].sum() / np.sqrt(max(1, len(f))) + bias for f in rows])
    slope, offset = platt(margins, y)
    return Model(weights, bias, slope, offset)


def scored(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with its score and predicted class; null and empty texts get the score of no features.

    Broadcast: one weight per feature slot, 1 MB at every scale. Output columns
    named like an input column are not allowed in ``columns``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns, F.col(text).alias("__text"))
    schema = kept.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([held.value.score(f) for f in features(batch.column(batch.num_columns - 1))])
            made = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*columns, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array([held.value.score(f) >= 0.5 for f in features(batch.column(place))], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return docs.mapInArrow(run, docs.schema)
