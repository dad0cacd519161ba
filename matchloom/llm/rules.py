"""Quality rules: gradient-boosted trees over document statistics, on top of fixed base rules.

Method.  Each text is reduced to counts (words, symbols, repeats, cases, lines), from
which come the base rules and the features of the trees.  Trees are grown level by level on
histograms with second-order gains for the logistic loss.  Features in ``FALLING`` may only lower
the verdict as they rise: a split that would break this is refused, and the mean of its two
values bounds the values below it on either side.  The forest is flattened into numpy
node arrays; scoring walks all trees of a batch of rows at once.

Scale.  The forest is fitted on the driver over a sample bounded by ``SAMPLE`` rows and
``SAMPLE_BYTES`` bytes of each class, and has at most ``TREES * 2**(DEPTH + 1)`` nodes.
Scoring is one map pass over the whole texts, with no shuffle.

Edge cases.  Null text reads as empty: all counts 0, base failed.  Repeated rows are judged
alike, a null id is kept as it is, other columns are ignored.  With fewer than 20
labelled rows, or without labels of both classes, the verdict is that of the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar, labelled, shared

SAMPLE, SAMPLE_BYTES = 4000, 8 << 20
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 48, 0.15, 1.0, 4.0
WINDOW = 5
#: Fixed characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words", "wide_share", "twin_share", "triple_share"]
#: Features that may only lower the verdict.
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "twin_share", "triple_share"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _class(bytes(range(65, 91))), _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT, _MARK = _class(b"0123456789"), _class(b"!?.,;:\"'()[]{}-_=+/\\@^~`")
#: First bytes of code points, and of those past ASCII.
_HEAD = np.array([not 0x80 <= b < 0xC0 for b in range(256)])
_WIDE = np.array([b >= 0xC0 for b in range(256)])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (int64) and the features (float32), one row a text."""
    parts = [_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in columnar.blocks(offsets)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)), np.float32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    starts, ends = columnar.words(data, offsets)
    row, word = columnar.rows_of(starts, offsets), columnar.span_hashes(data, starts, ends)
    n_words = np.bincount(row, minlength=n)
    solid = ~columnar.WHITE[data]
    chars = _per_row(_HEAD[data] & solid, offsets)
    symbols = _per_row(SYMBOLS[data], offsets)
    line_row, line = columnar.lines(data, offsets)
    n_lines, dup_lines = np.bincount(line_row, minlength=n), columnar.again(line_row, line, n)
    repeat = _covered(row, word, n)
    twin = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    triple = columnar.runs_hash(word, 3)
    inside = row[2:] == row[:-2] if len(triple) else np.zeros(0, bool)
    w, c = np.maximum(1, n_words), np.maximum(1, chars)
    letters = np.maximum(1, _per_row(_LETTER[data], offsets))
    features = [
        np.log1p(n_words), chars / w, symbols / c, dup_lines / np.maximum(1, n_lines), repeat / w,
        _per_row(_UPPER[data], offsets) / letters, _per_row(_DIGIT[data], offsets) / c, _per_row(_MARK[data], offsets) / c,
        n_words / np.maximum(1, n_lines), _per_row(_WIDE[data], offsets) / c,
        np.bincount(row[1:][twin], minlength=n) / w, columnar.again(row[: len(triple)][inside], triple[inside], n) / w,
    ]
    return np.stack([n_words, chars, symbols, dup_lines, repeat], 1).astype(np.int64), np.stack(features, 1).astype(np.float32)


def _covered(row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """For each row, the words in windows of WINDOW words that the row holds at least twice."""
    window = columnar.runs_hash(word, WINDOW)
    if not len(window):
        return np.zeros(n, np.int64)
    at = np.flatnonzero(row[WINDOW - 1 :] == row[: len(window)])
    at = at[columnar.repeated(row[at], window[at])]
    edge = np.zeros(len(word) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Forest:
    """Flat node arrays; a leaf points to itself.  The verdict is the sigmoid of the sum."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Forest:
        n = len(y)
        if n < 20 or y.min() == y.max():
            empty = np.zeros(0, np.int32)
            return cls(empty, np.zeros(0, np.float32), empty, empty, np.zeros(0), empty, 1.0)
        weight = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        falling = np.isin(FEATURES, FALLING)
        nodes: list[list] = []  # feature, threshold, left, right, value
        roots, total = [], np.zeros(n)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            roots.append(len(nodes))
            level = [(cls._leaf(nodes), np.arange(n), -np.inf, np.inf)]
            for depth in range(DEPTH + 1):
                below = []
                for k, rows, low, high in level:
                    nodes[k][4] = RATE * cls._value(g[rows].sum(), h[rows].sum(), low, high)
                    split = cls._split(binned, edges, g, h, rows, low, high, falling) if depth < DEPTH else None
                    if split is None:
                        total[rows] += nodes[k][4]
                        continue
                    f, b, a, c = split
                    goes = binned[rows, f] <= b
                    left, right = cls._leaf(nodes), cls._leaf(nodes)
                    nodes[k][:4] = [f, edges[f][b], left, right]
                    middle = (a + c) / 2
                    below.append((left, rows[goes], middle if falling[f] else low, high))
                    below.append((right, rows[~goes], low, middle if falling[f] else high))
                level = below
        f, t, left, right, value = zip(*nodes)
        return cls(np.array(f, np.int32), np.array(t, np.float32), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), 0.0)

    @staticmethod
    def _leaf(nodes: list[list]) -> int:
        k = len(nodes)
        nodes.append([0, np.inf, k, k, 0.0])
        return k

    @staticmethod
    def _value(g, h, low: float, high: float):
        return np.clip(g / (h + L2), low, high)

    @classmethod
    def _split(cls, binned, edges, g, h, rows, low, high, falling):
        """Feature, bin and the values on both sides of the best allowed split."""
        best, found = 1e-6, None
        gain = lambda a, b, v: a * v - 0.5 * (b + L2) * v * v
        ga, ha = g[rows].sum(), h[rows].sum()
        whole = gain(ga, ha, cls._value(ga, ha, low, high))
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            vl, vr = cls._value(gl, hl, low, high), cls._value(ga - gl, ha - hl, low, high)
            won = gain(gl, hl, vl) + gain(ga - gl, ha - hl, vr) - whole
            bad = (hl < LEAST / 4) | (ha - hl < LEAST / 4) | (falling[f] & (vl < vr))
            won[bad] = -1
            k = int(np.argmax(won))
            if won[k] > best:
                best, found = won[k], (f, k, float(vl[k]), float(vr[k]))
        return found

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability that a row is good; 0.73 for each if nothing was learned."""
        out = np.full(len(x), self.bias)
        for i in range(0, len(x) if len(self.roots) else 0, 4096):
            part = x[i : i + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(DEPTH):
                goes = np.take_along_axis(part, self.feature[at], 1) <= self.threshold[at]
                at = np.where(goes, self.left[at], self.right[at])
            out[i : i + 4096] += self.value[at].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Forest:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    rows = labelled.sample(documents, known, "_label", SAMPLE, SAMPLE_BYTES)
    _, x = statistics(*columnar.utf8(rows["text"]))
    return Forest.fit(x, (rows["_label"].to_numpy() > 0).astype(float))


def judge(documents: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the forest's score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = statistics(*columnar.utf8(batch.column(1)))
            p, failed = forest.scores(x), base_failed(counts)
            arrays = [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return shared.bounded(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")
