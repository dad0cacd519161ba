"""Quality classifier: a linear SVM over naive-Bayes scaled n-gram indicators.

Method.  A text becomes the set of its byte n-grams (n = 1, 2, 3; the longer ones
hashed) and of marks for adjacent repeats of a word and for copies of a line.  Each
indicator is scaled by the log ratio of its smoothed frequencies in the two
classes; the vector is brought to length one, and a linear hinge-loss model is fitted
by dual coordinate descent.  A logistic curve fitted on margins of rows that the
descent has not seen turns margins into probabilities.

Scale.  The model is fitted on the driver over a sample bounded by
``QualityModel.SAMPLE`` rows and ``SAMPLE_BYTES`` bytes of each class; it is one
array of 2**17 float32 values whatever the corpus.  Scoring is one map pass over the
whole texts, with no shuffle.

Edge cases.  Null text reads as empty; an empty text has no indicator and scores the
intercept; a null id is never held out and never learned from; repeated rows are
scored alike; with fewer than 4 labelled rows or no rows of one class the score is the share of class 1 (0.5 if
there are no rows at all); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar, labelled, shared

_BITS = 16
_SPACE = 1 << _BITS
#: Bytes and byte pairs at their own value, then hashed triples, then marks.
_WIDTH = 2 * _SPACE + 512
_SINGLE, _TRIPLE, _MARK = 2 * _SPACE, _SPACE, 2 * _SPACE + 256


def indicators(data: np.ndarray) -> np.ndarray:
    """Feature numbers of one text, with repeats."""
    n = len(data)
    parts = [data.astype(np.int32) + _SINGLE]
    if n > 1:
        wide = data.astype(np.uint32)
        pair = (wide[:-1] << np.uint32(8)) | wide[1:]
        parts.append(pair.astype(np.int32))
        if n > 2:
            triple = ((pair[:-1] << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1)
            parts.append((triple >> np.uint32(32 - _BITS)).astype(np.int32) + _TRIPLE)
    return np.concatenate(parts)


def _share_mark(base: int, share: np.ndarray) -> np.ndarray:
    return _MARK + base + np.minimum(31, np.ceil(np.sqrt(np.clip(share, 0, 1)) * 31)).astype(np.int32)


def marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Three feature numbers a row: levels of the shares of repeated words beside each other, of repeated word triples and of repeated lines."""
    n = len(offsets) - 1
    starts, ends = columnar.words(data, offsets)
    row = columnar.rows_of(starts, offsets)
    hashes = columnar.span_hashes(data, starts, ends)
    count = np.maximum(1, np.bincount(row, minlength=n))
    twice = np.zeros(len(row), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out = np.empty((n, 3), np.int32)
    out[:, 0] = _share_mark(0, np.bincount(row[twice], minlength=n) / count)
    triples = columnar.runs_hash(hashes, 3)
    inside = row[2:] == row[: len(triples)] if len(triples) else np.zeros(0, bool)
    out[:, 1] = _share_mark(64, columnar.again(row[: len(triples)][inside], triples[inside], n) / count)
    line_row, line = columnar.lines(data, offsets)
    out[:, 2] = _share_mark(128, columnar.again(line_row, line, n) / np.maximum(1, np.bincount(line_row, minlength=n)))
    return out


@dataclass
class QualityModel:
    """Weights by feature number (already scaled by the class ratios), and the curve."""

    weights: np.ndarray
    scales: np.ndarray
    bias: float
    slope: float
    shift: float

    #: Bounds of the fitting sample: rows and bytes of text of each class.
    SAMPLE, SAMPLE_BYTES = 4000, 8 << 20
    COST, ROUNDS, SMOOTHING = 1.0, 12, 1.0

    @classmethod
    def fit(cls, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> QualityModel:
        n = len(labels)
        share = float(np.mean(labels)) if n else 0.5
        if n < 4 or share in (0.0, 1.0):
            share = min(max(share, 1e-6), 1 - 1e-6)
            return cls(np.zeros(_WIDTH, np.float32), np.ones(_WIDTH, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
        level = marks(data, offsets)
        sets = [np.unique(np.concatenate((indicators(data[offsets[k] : offsets[k + 1]]), level[k]))) for k in range(n)]
        fit = np.arange(n) % 4 != 3  # the rest sets the curve
        ratio = cls._ratios([s for s, f in zip(sets, fit) if f], labels[fit])
        weights, bias = cls._descend([s for s, f in zip(sets, fit) if f], labels[fit], ratio)
        held = cls(weights, ratio, bias, 1.0, 0.0)
        margins = np.array([held._margin(s) for s, f in zip(sets, fit) if not f])
        slope, shift = labelled.logistic(margins, labels[~fit])
        return cls(weights, ratio, bias, slope, shift)

    @classmethod
    def _ratios(cls, sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """The log ratio of the smoothed shares of texts of class 1 and of class 0 that have the feature."""
        count = np.zeros((2, _WIDTH))
        for s, y in zip(sets, labels):
            count[int(y), s] += 1
        size = np.bincount(labels.astype(int), minlength=2)[:, None]
        p = (count + cls.SMOOTHING) / (size + 2 * cls.SMOOTHING)
        return np.log(p[1] / p[0]).astype(np.float32)

    @classmethod
    def _descend(cls, sets: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
        """Dual coordinate descent for the L1 hinge loss; classes weigh the same in total."""
        n, sign = len(sets), np.where(labels > 0, 1.0, -1.0)
        rows = [ratio[s].astype(np.float64) for s in sets]
        rows = [r / max(1e-9, float(np.sqrt(r @ r))) for r in rows]
        cost = np.where(labels > 0, n / (2 * max(1, labels.sum())), n / (2 * max(1, n - labels.sum()))) * cls.COST
        w, bias, alpha, rng = np.zeros(_WIDTH), 0.0, np.zeros(n), np.random.default_rng(5)
        for _ in range(cls.ROUNDS):
            moved = 0.0
            for k in rng.permutation(n):
                s, x = sets[k], rows[k]
                slope = sign[k] * (w[s] @ x + bias) - 1.0
                new = min(max(alpha[k] - slope / 2.0, 0.0), cost[k])  # |x|^2 + 1 for the bias
                if step := (new - alpha[k]) * sign[k]:
                    w[s] += step * x
                    bias += step
                    alpha[k] = new
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        return (w * ratio).astype(np.float32), bias

    def _margin(self, features: np.ndarray) -> float:
        r = self.scales[features]
        return float(self.weights[features].sum(dtype=np.float64) / max(1e-9, np.sqrt((r.astype(np.float64) ** 2).sum())) + self.bias)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        out = np.empty(len(offsets) - 1)
        seen, squares = np.zeros(_WIDTH, np.float32), self.scales**2
        norm = np.zeros(_WIDTH, np.float32)
        for i, j in columnar.blocks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            level = marks(part, at)
            for k in range(j - i):
                f = np.concatenate((indicators(part[at[k] : at[k + 1]]), level[k]))
                seen[f], norm[f] = self.weights[f], squares[f]
                out[i + k] = seen.sum(dtype=np.float64) / max(1e-9, np.sqrt(norm.sum(dtype=np.float64))) + self.bias
                seen[f] = norm[f] = 0
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0) -> QualityModel:
    """Fits on labelled documents outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    known = known.where(labelled.fold(F.col("doc_id"), folds) != held)
    rows = labelled.sample(documents, known, "_label", QualityModel.SAMPLE, QualityModel.SAMPLE_BYTES)
    data, offsets = columnar.utf8(rows["text"])
    order = np.random.default_rng(3).permutation(len(offsets) - 1)
    return _fit_in_order(data, offsets, rows["_label"].to_numpy() > 0, order)


def _fit_in_order(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, order: np.ndarray) -> QualityModel:
    size = np.diff(offsets)[order]
    at = np.concatenate(([0], np.cumsum(size)))
    joined = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in order]) if len(order) else data
    return QualityModel.fit(joined, at, labels[order].astype(np.int64))


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(*columnar.utf8(batch.column(1)))
            ids = batch.column(0)
            out = [np.array(labelled.folds_of(ids, folds)) == held if len(ids) else np.zeros(0, bool), p, (p >= threshold).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], ["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return shared.bounded(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
