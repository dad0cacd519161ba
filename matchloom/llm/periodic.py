"""Runs of words that repeat with a period, found and collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least
``max(least, 2 q)`` words that no neighbouring word extends with that period.

Method.  A run of that length holds two overlapping copies of at least k = ceil(least / 2) words, so each of its words
lies in a k-gram that the text holds twice.  All other words are masked; what is left falls into segments, which
are masked once more by their own k-grams, and segments of fewer than ``least`` words go.  On the surviving segments Main and Lorentz' division
runs, level by level for all segments of a block of texts at once: a run crosses the middle of some part, where two words one
period apart are extended in both directions.  Extensions are exact: they compare ranks of stretches of 1, 2, 4, ... words.
One stretch is found with every multiple of its period; the smallest stays.

Scale.  One map pass over whole texts, no shuffle.  Work arrays cover 256 KB of text or one document; a surviving segment of m words
takes log2(m) arrays of ranks and m candidates a level.

Edge cases.  Null and empty texts have no words: no runs, an empty collapsed text.  White space between words becomes one space in the collapsed
text, also where nothing is dropped.  Repeated rows are treated alike, a null id is kept, other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columnar, shared

LEAST = 12
#: Candidates that are extended at a time.
AT_ONCE = 1 << 18


def covered(word: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its row holds at least twice."""
    if len(word) < k:
        return np.zeros(len(word), bool)
    gram = columnar.runs_hash(word, k)
    at = np.flatnonzero(row[: len(gram)] == row[k - 1 :])
    twice = np.zeros(len(word), np.int64)
    twice[at[columnar.repeated(row[at], gram[at])]] = 1
    seen = np.concatenate((np.zeros(k, np.int64), np.cumsum(twice)))
    return seen[k:] > seen[:-k]


def segments(word: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that runs can hold, and the segment of each."""
    at, part = np.arange(len(word)), row
    for _ in range(2):  # by the k-grams of the text, then by those of each segment
        at, part = at[keep := covered(word[at], part, (least + 1) // 2)], part[keep]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= least
        at, part = at[long], part[long]
    return at, part


class Extensions:
    """How far stretches of words agree, forwards and backwards, by ranks of their powers of two."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        rank = np.append(np.unique(word, return_inverse=True)[1], n)  # the last stands for what is past the end
        self.ranks, h = [], 1
        while len(np.unique(rank)) <= n:
            self.ranks.append(rank.astype(np.int32))
            after = np.append(rank[h:], np.arange(h) + n + 1) if h <= n else np.arange(n + 1)
            rank = np.unique(rank * np.int64(2 * n + 2) + after, return_inverse=True)[1]
            h *= 2

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.ranks[0][i] == self.ranks[0][j]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            out += (self.ranks[level][i + out] == self.ranks[level][j + out]).astype(np.int64) << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << level), j - out - (1 << level)
            inside = a >= 0
            out += (inside & (self.ranks[level][np.maximum(a, 0)] == self.ranks[level][np.maximum(b, 0)])).astype(np.int64) << level
        return out


def _smallest(found: list[np.ndarray]) -> np.ndarray:
    """Rows (start, end, period), for each stretch with its smallest period."""
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def main_lorentz(word: np.ndarray, part: np.ndarray, least: int) -> np.ndarray:
    """Start, end and period of every run; words of different parts never agree."""
    if not len(word):
        return np.zeros((0, 3), np.int64)
    extend = Extensions(columnar.mix(word + (part.astype(np.uint64) + np.uint64(1)) * columnar.FAR_CODE))
    if not extend.ranks:
        return np.zeros((0, 3), np.int64)
    left = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    right = np.append(left[1:], len(word))
    found: list[np.ndarray] = []
    while len(left):
        middle = (left + right) // 2
        # the middle is the first of two words a period apart, or the second
        sizes = np.concatenate((right - middle, middle - left))
        ends = np.cumsum(sizes)
        level: list[np.ndarray] = []
        for start in range(0, int(ends[-1]), AT_ONCE):
            k = np.arange(start, min(start + AT_ONCE, int(ends[-1])))
            node = np.searchsorted(ends, k, "right")
            period = k - (ends - sizes)[node] + 1
            second = node >= len(middle)
            i = middle[node % len(middle)] - np.where(second, period, 0)
            j = i + period
            near = extend.equal(i, j) | (extend.equal(i - 1, j - 1) & (i > 0))
            i, j, period = i[near], j[near], period[near]
            start_at, end_at = i - extend.backward(i, j), j + extend.forward(i, j)
            good = end_at - start_at >= np.maximum(least, 2 * period)
            level.append(np.stack((start_at[good], end_at[good], period[good]), 1))
        found.append(_smallest(level))
        left, right = np.concatenate((left, middle)), np.concatenate((middle, right))
        left, right = left[big := right - left >= least], right[big]
    return _smallest(found)


def runs_of(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, start, length, period) of the runs, in that order with period before length, and the spans of the words that collapsing drops."""
    start, end = columnar.words(data, offsets)
    row = columnar.rows_of(start, offsets)
    word = columnar.span_hashes(data, start, end)
    at, part = segments(word, row, least)
    found = main_lorentz(word[at], part, least)
    s, length, period = at[found[:, 0]], found[:, 1] - found[:, 0], found[:, 2]
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, s + period, 1)
    np.add.at(change, s + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    runs = np.stack((row[s], s - first[row[s]], length, period), 1) if len(s) else np.zeros((0, 4), np.int64)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))], np.stack((start[gone], end[gone]), 1), row[gone]


def _collapsed(text: bytes, spans: np.ndarray) -> bytes:
    """The words of the text outside the spans, joined by one space."""
    if not len(spans):
        return b" ".join(text.split())
    out, at = [], 0
    for start, end in spans.tolist():
        out.append(text[at:start])
        at = end
    return b" ".join(b" ".join((*out, text[at:])).split())


def find(documents: DataFrame, text: Column | str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, runs (start, length, period; by start, then period) and collapsed, the text without the repeats inside runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = columnar.utf8(batch.column(1))
            counts, found, texts = [], [], []
            for i, j in columnar.blocks(offsets):
                base, n = offsets[i], j - i
                block = data[base : offsets[j]]
                runs, spans, row = runs_of(block, offsets[i : j + 1] - base, least)
                counts.append(np.bincount(runs[:, 0], minlength=n))
                found.append(runs[:, 1:])
                bounds = np.searchsorted(row, np.arange(n + 1))
                for k in range(n):
                    begin = offsets[i + k] - base
                    texts.append(_collapsed(block[begin : offsets[i + k + 1] - base].tobytes(), spans[bounds[k] : bounds[k + 1]] - begin))
            count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            runs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), runs)
            raw = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), lists, pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())], ["doc_id", "n_runs", "runs", "collapsed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = shared.bounded(documents).select("doc_id", (F.col(text) if isinstance(text, str) else text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_runs long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, for one id in ten with a period in its tail: with h the CRC-32 of the decimal id and g = h div 10,
    word a + i becomes word a + i % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:  # sees its words as a value, which is made once a row
        g, n = F.floor(h / 10), F.nullif(F.size(w), F.lit(0)).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: w[place(i)]), " ")

    return F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), tail)[0], text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """What ``find`` found, as the longest run and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", "n_runs", best.alias("b"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    b = F.col("b")
    exponent = F.floor(F.lit(1000) * b["length"] / -b["period"])
    return rows.select(
        "doc_id", "n_runs", (-b["start"]).alias("start"), b["length"].alias("length"), (-b["period"]).alias("period"), exponent.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
