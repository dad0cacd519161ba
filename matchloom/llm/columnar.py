"""Vectorised views over Arrow text columns, shared by the text operators.

Everything here works on the UTF-8 buffers that Spark hands to ``mapInArrow``:
no Python string is made for a document unless a caller asks for it.  Memory is
bounded by ``blocks``: work arrays cover a few hundred KB of text, or one document
where a single document is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that work arrays, which take some forty times as much, cover at a time.
BLOCK_BYTES = 1 << 18

#: Bytes that separate words: space, tab, LF, VT, FF, CR.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: All ASCII but letters and digits, for words without punctuation.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(0x5EED)
_ODD = np.uint64(1)
#: A random 64-bit value for each byte, and odd multipliers for each place in a word.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _ODD
PLACE_CODE = _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | _ODD
FAR_CODE = np.uint64(0x9E3779B97F4A7C15)
#: The same with A-Z read as a-z.
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
#: Multipliers for the places of words in an n-gram.
WORD_CODE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _ODD


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())  # new offsets, the same bytes
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-white bytes; runs end with their row."""
    solid = ~white[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = solid[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = solid[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap, in order; empty spans give 0."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    full = np.flatnonzero(lengths > 0)
    at = 0
    while at < len(full):  # a few hundred KB at a time
        to = max(at + 1, int(np.searchsorted(ends[full], starts[full[at]] + (BLOCK_BYTES << 1), "right")))
        part = full[at:to]
        s, size = starts[part], lengths[part]
        begins = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begins, size)
        value = code[data[place + np.repeat(s, size)]] * PLACE_CODE[place & 0xFFF]
        if size.max() > 0x1000:
            value *= (place >> 12).astype(np.uint64) * FAR_CODE * np.uint64(2) + _ODD
        out[part] = mix(np.add.reduceat(value, begins) + size.astype(np.uint64) * FAR_CODE)
        at = to
    return out


def runs_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n values in a row; empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m] * WORD_CODE[0]
    for k in range(1, n):
        total = total + hashes[k : k + m] * WORD_CODE[k]
    return mix(total)


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every LF-split line that holds a word, in order."""
    cut = np.flatnonzero(data == 10) + 1
    begin = np.union1d(cut[cut < len(data)], offsets[:-1][offsets[:-1] < len(data)]).astype(np.int64)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = np.append(begin[1:], len(data))
    row = rows_of(begin, offsets)
    solid = np.concatenate(([0], np.cumsum(~WHITE[data], dtype=np.int64)))
    worded = solid[stop] > solid[begin]
    return row[worded], span_hashes(data, begin[worded], (stop - (data[stop - 1] == 10))[worded])


def _keys(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(value + (row.astype(np.uint64) + _ODD) * FAR_CODE)


def again(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, how many of its values an equal value precedes."""
    if not len(row):
        return np.zeros(n, np.int64)
    _, first = np.unique(_keys(row, value), return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def repeated(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is found at least twice in its row."""
    key = _keys(row, value)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(row), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
