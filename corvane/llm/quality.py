"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut the line: P(grade <= j) = logistic(threshold_j - w . x). It gives
an expected grade and the probability of the upper tail, by which documents are
selected. Features: lower-case words, runs of symbols, and shape features
(shares of capitals, symbols and distinct words, mean word length).

``fit`` learns from at most ``SAMPLE`` labels (the documented bound, which holds
at any size), those with the least hashes.

Defined results: null text is the empty text; rows without a label are only
scored; labels that are null are left out; without labelled rows every document
has expected grade 0 and tail probability 0; repeated rows are documents of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, mapped, utf8

BITS = 18
#: Labels that the weights are fitted on, at most.
SAMPLE = 6000
#: A feature counts if at least so many sampled rows have it.
LEAST_ROWS = 3
RIDGE, ROUNDS, RATE = 1e-4, 300, 0.05
#: Documents with at least this probability of the best grades are selected.
SELECT = 0.5

_SYMBOL = kernels.table_of(bytes(i for i in range(33, 127) if not chr(i).isalnum())).astype(bool)
_UPPER = kernels.table_of(bytes(range(65, 91))).astype(bool)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, cell) pairs, sorted."""
    buf, starts = kernels.concatenated(texts)
    low = kernels.LOWER[buf]
    n = len(texts)
    s, e = kernels.spans(kernels.ALNUM_WORD[low])
    ps, pe = kernels.spans(_SYMBOL[buf])
    word, mark = kernels.span_hashes(low, s, e), kernels.span_hashes(low, ps, pe)
    doc_of = lambda at: np.searchsorted(starts, at, "right") - 1
    wd, pd_ = doc_of(s), doc_of(ps)
    per = lambda d, w=None: np.bincount(d, weights=w, minlength=n)
    n_words, size = per(wd), np.diff(starts) - 1
    cell = (word >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique(wd * (1 << BITS) + cell)
    distinct = per(pairs >> BITS)
    upper = np.add.reduceat(np.append(_UPPER[buf], False).astype(np.int64), starts[:-1]) if n else np.zeros(0)
    shape = [
        np.minimum(9, 10 * upper / np.maximum(1, size)),
        np.minimum(9, 20 * per(pd_, pe - ps) / np.maximum(1, size)),
        np.minimum(9, 10 * distinct / np.maximum(1, n_words)),
        np.minimum(15, per(wd, e - s) / np.maximum(1, n_words)),
        np.minimum(15, np.log2(1 + n_words)),
    ]
    shaped = [np.arange(n) * (1 << BITS) + (kernels.mix(np.floor(v).astype(np.uint64) + np.uint64(1000 * (k + 1))) >> np.uint64(64 - BITS)).astype(np.int64) for k, v in enumerate(shape)]
    marks = pd_ * (1 << BITS) + (kernels.mix(mark) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique(np.concatenate([pairs, marks, *shaped]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than grades

    def grades(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, probability of the best grade."""
        if not len(self.thresholds):
            return np.zeros(len(texts)), np.zeros(len(texts))
        row, cell = features(texts)
        line = np.bincount(row, weights=self.weights[cell], minlength=len(texts))
        above = 1 - _logistic(self.thresholds[None, :] - line[:, None])  # P(grade > j)
        return above.sum(axis=1), above[:, -1]


def fit_rows(row: np.ndarray, cell: np.ndarray, grade: np.ndarray, n_grades: int) -> Model:
    """Cumulative-link regression by Adam on the full sample."""
    n, size = len(grade), 1 << BITS
    common = np.bincount(cell, minlength=size) >= LEAST_ROWS
    row, cell = row[common[cell]], cell[common[cell]]
    used, where = np.unique(cell, return_inverse=True)
    w = np.zeros(len(used))
    share = np.clip(np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / max(1, n), 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    gap = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # first threshold, logs of the steps
    state = [np.zeros(len(w) + len(gap)) for _ in range(2)]
    for step in range(1, ROUNDS + 1):
        thresholds = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
        line = np.bincount(row, weights=w[where], minlength=n)
        bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper, lower = _logistic(bounds[grade + 1] - line), _logistic(bounds[grade] - line)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = (du - dl) / n  # of the loss by the line
        dw = np.bincount(where, weights=slope[row], minlength=len(w)) + RIDGE * w
        dt = np.zeros(n_grades + 1)
        np.add.at(dt, grade + 1, -du / n)
        np.add.at(dt, grade, dl / n)
        dt = dt[1:-1]
        tail = np.cumsum(dt[::-1])[::-1]
        dg = np.concatenate([tail[:1], tail[1:] * np.exp(gap[1:])])
        g = np.concatenate([dw, dg])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, gap = w - move[: len(w)], gap - move[len(w) :]
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])])))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column("text"))
        for part in blocks(map(len, texts)):
            row, cell = features(texts[part])
            cells = np.split(cell.astype(np.int32), np.searchsorted(row, np.arange(1, part.stop - part.start)))
            yield pa.RecordBatch.from_pydict({"grade": batch.column("grade").slice(part.start, part.stop - part.start), "cells": pa.array([c.tobytes() for c in cells], pa.binary())})


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """Learn from ``ratings`` (doc_id, grade from 0) of ``docs`` (doc_id, text)."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    total = rated.count()
    if not total:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(0))
    below = int(min(1.0, 2 * sample / total) * (2**53 - 1))
    # Twice as many as wanted by rate, then exactly so many by rank; bounded by the sample's size, so it may be broadcast.
    # Ids may repeat in ``docs``, so what the join gives is ranked and cut again.
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("quality")), 11)
    picked = rated.where(draw <= below).orderBy(draw, "doc_id", "grade").limit(sample)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    met = met.orderBy(draw, "doc_id", "grade", F.xxhash64("text")).limit(sample)
    rows = met.select("grade", "text").transform(mapped, _sampled, "grade int, cells binary").collect()
    rows.sort(key=lambda r: (r["grade"], r["cells"]))
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(0))
    grade = np.clip(np.array([r["grade"] for r in rows]), 0, n_grades - 1)
    cells = [np.frombuffer(r["cells"], np.int32).astype(np.int64) for r in rows]
    return fit_rows(np.repeat(np.arange(len(rows)), [len(c) for c in cells]), np.concatenate(cells), grade, n_grades)


def score(docs: DataFrame, model: Model, select: float = SELECT) -> DataFrame:
    """doc_id, expected_grade, p_best, selected for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for part in blocks(map(len, texts)):
                expected, tail = held.value.grades(texts[part])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(part.start, part.stop - part.start), "expected_grade": pa.array(expected, pa.float64()), "p_best": pa.array(tail, pa.float64()), "selected": pa.array(tail >= select, pa.bool_())})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.transform(mapped, run, "doc_id long, expected_grade double, p_best double, selected boolean")
