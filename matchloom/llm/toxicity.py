"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method.  Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered.
A text becomes the set of its hashed words, word pairs, and pairs with one word
between them; a longer word also counts by its stems (its first bytes), as inflected and
compounded forms are rare one by one.  The model is learned online by FTRL-proximal: each coordinate has its own
rate, from the sum of its squared gradients, and L1 leaves a coordinate at zero until the
evidence exceeds the penalty.  What is sent to the executors is the short list of
coordinates that are not zero.

Scale.  Fitting is on the driver, over a sample bounded by ``ToxicityModel.SAMPLE``
rows and ``SAMPLE_BYTES`` bytes of each class.  Weights are at most 2**20 float32 whatever the corpus.
Scoring is one map pass over the whole texts, with no shuffle.

Edge cases.  Null text reads as empty; an empty text scores the bias alone; a null id
is never held out and never learned from; repeated rows score alike; with no labelled rows
every score is 0.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar, labelled, shared

_BITS = 20
#: Lengths in bytes of the word beginnings that count as stems of longer words.
STEMS = (5, 6, 7, 8, 9)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their rows, with repeats, for a run of texts."""
    starts, ends = columnar.words(data, offsets, columnar.NOT_ALNUM)
    row = columnar.rows_of(starts, offsets)
    word = columnar.span_hashes(data, starts, ends, columnar.LOWER_CODE)
    parts, rows = [word], [row]
    for gap, salt in ((1, 0xA5), (2, 0x5A)):
        if len(word) > gap:
            near = row[gap:] == row[:-gap]
            pair = columnar.mix(word[:-gap] * columnar.WORD_CODE[0] + word[gap:] * columnar.WORD_CODE[1] + np.uint64(salt))
            parts.append(pair[near])
            rows.append(row[gap:][near])
    for size in STEMS:
        longer = ends - starts > size
        stem = columnar.span_hashes(data, starts[longer], starts[longer] + size, columnar.LOWER_CODE)
        parts.append(columnar.mix(stem + np.uint64(size)))
        rows.append(row[longer])
    return (np.concatenate(parts) >> np.uint64(64 - _BITS)).astype(np.int32), np.concatenate(rows)


@dataclass
class ToxicityModel:
    """The coordinates that are not zero, their weights, and the bias."""

    index: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    #: Bounds of the fitting sample: rows and bytes of text of each class.
    SAMPLE, SAMPLE_BYTES = 4000, 8 << 20
    RATE, BETA, L1, L2, ROUNDS = 0.5, 1.0, 8.0, 0.1, 10

    @classmethod
    def fit(cls, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> ToxicityModel:
        """The model of all rows; a second one of three quarters of them gives margins of unseen rows, which set the curve."""
        n = len(labels)
        if not n:
            return cls(np.zeros(0, np.int32), np.zeros(0, np.float32), -30.0)
        sets, sizes, seen = [], [], np.zeros(1 << _BITS, bool)
        for i, j in columnar.blocks(offsets):
            part, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key = np.unique((row.astype(np.int64) << _BITS) | part)
            sets.append((key & ((1 << _BITS) - 1)).astype(np.int32))
            sizes.append(np.bincount(key >> _BITS, minlength=j - i))
            seen[sets[-1]] = True
        names, place = np.flatnonzero(seen).astype(np.int32), (np.cumsum(seen) - 1).astype(np.int32)
        f, at = np.concatenate([place[part] for part in sets]), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))  # the coordinates in use, side by side
        del sets
        model = cls._learn(f, at, labels, np.arange(n), names)
        unseen = np.arange(n) % 4 == 3
        if len(set(labels[unseen])) == 2:
            part = cls._learn(f, at, labels, np.flatnonzero(~unseen), names)
            table = np.zeros(len(names))
            table[np.searchsorted(names, part.index)] = part.weights
            margins = np.array([table[f[at[k] : at[k + 1]]].sum() + part.bias for k in np.flatnonzero(unseen)])
            model.slope, model.shift = labelled.logistic(margins, labels[unseen])
        return model

    @classmethod
    def _learn(cls, f: np.ndarray, at: np.ndarray, labels: np.ndarray, rows: np.ndarray, names: np.ndarray) -> ToxicityModel:
        """From rows of coordinates, which are places in ``names``."""
        z, squares, table, rng = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), np.random.default_rng(11)
        bias, bias_squares = 0.0, 1.0
        # classes weigh the same in total, so that the curve is centred between them
        n, up = len(rows), max(1, int(labels[rows].sum()))
        weight = (n / (2 * max(1, n - up)), n / (2 * up))
        for _ in range(cls.ROUNDS):
            for k in rng.permutation(rows):
                x = f[at[k] : at[k + 1]]
                w = table[x]
                p = 1 / (1 + np.exp(-max(-30.0, min(30.0, float(w.sum()) + bias))))
                g = (p - labels[k]) * weight[int(labels[k])]
                old = squares[x]
                new = old + g * g
                now = z[x] + g - (np.sqrt(new) - np.sqrt(old)) / cls.RATE * w
                squares[x], z[x], table[x] = new, now, cls._weights(now, new)
                bias_squares += g * g
                bias -= g * cls.RATE / np.sqrt(bias_squares)
        kept = np.flatnonzero(table)
        return cls(names[kept].astype(np.int32), table[kept].astype(np.float32), float(bias))

    @classmethod
    def _weights(cls, z: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """The closed form of the proximal step."""
        return np.where(np.abs(z) <= cls.L1, 0.0, (np.sign(z) * cls.L1 - z) / ((cls.BETA + np.sqrt(squares)) / cls.RATE + cls.L2))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        out = np.full(len(offsets) - 1, self.bias)
        table = np.zeros(1 << _BITS, np.float32)
        table[self.index] = self.weights
        for i, j in columnar.blocks(offsets):
            f, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hit = np.flatnonzero(table[f])
            key = np.unique((row[hit].astype(np.int64) << _BITS) | f[hit])
            out[i:j] += np.bincount(key >> _BITS, table[key & ((1 << _BITS) - 1)], j - i)
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0) -> ToxicityModel:
    """Fits on labelled documents outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    known = known.where(labelled.fold(F.col("doc_id"), folds) != held)
    rows = labelled.sample(documents, known, "_label", ToxicityModel.SAMPLE, ToxicityModel.SAMPLE_BYTES)
    data, offsets = columnar.utf8(rows["text"])
    return ToxicityModel.fit(data, offsets, (rows["_label"].to_numpy() > 0).astype(np.int64))


def score(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(*columnar.utf8(batch.column(1)))
            ids = batch.column(0)
            out = [np.array(labelled.folds_of(ids, folds)) == held if len(ids) else np.zeros(0, bool), p, (p >= threshold).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], ["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return shared.bounded(documents).select("doc_id", "text").mapInArrow(shared.released(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    schema = documents.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*columnar.utf8(batch.column(at))) < threshold))

    return shared.bounded(documents).mapInArrow(shared.released(run), schema)
