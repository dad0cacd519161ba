"""Edit distances and Jaro similarity between strings, with the rules for nulls.

Distances are taken on ``norm`` of both sides.  Two nulls are ``NULLS`` apart; a null is as far from a text as
that is long, and a null second side is of unknown distance from an empty text.  Levenshtein runs in the JVM.
The others run over Arrow batches, where tables of distances are filled for many pairs at a time, row by row: distinct pairs are sorted by
length, and a step of numpy fills one row of each pair's table.  With a limit, only cells near the diagonal are filled
and pairs that have passed the limit drop out.  What equality, nulls or lengths decide is not sent to Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .norm import norm, same, text

#: The distance between two nulls.
NULLS = 2147483647
#: Cells of all tables' rows that are worked on at a time.
CELLS = 1 << 15
_FAR = 1 << 28


def _with_nulls(a: Column, b: Column, distance: Column) -> Column:
    return (
        F.when(same(a, b), 0)
        .when(a.isNull() & b.isNull(), NULLS)
        .when(a.isNull(), F.length(F.rtrim(b)))
        .when(b.isNull(), F.nullif(F.length(F.rtrim(a)), F.lit(0)))
        .otherwise(distance)
        .cast("int")
    )


def levenshtein_distance(a: Column | str, b: Column | str, most: Column | None = None) -> Column:
    """Insertions, deletions and substitutions."""
    a, b = text(a), text(b)
    return _with_nulls(a, b, F.levenshtein(norm(a), norm(b)))


def _spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one row each padded with zeros, and their numbers."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _blocks(size_a: np.ndarray, size_b: np.ndarray) -> list[np.ndarray]:
    """Pairs of like lengths, shortest first, as many at a time as ``CELLS`` allows."""
    order = np.lexsort((size_b, size_a))
    out, at = [], 0
    while at < len(order):
        width = np.maximum.accumulate(size_b[order[at : at + CELLS]]) + 1
        take = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, "right")))
        out.append(order[at : at + take])
        at += take
    return out


def _edits(a: list[str], b: list[str], most: np.ndarray | None, free: bool) -> np.ndarray:
    """Distances of pairs; those above ``most``, if it is given, are most + 1.  ``free``: text may be edited between swapped characters."""
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    if most is not None:
        near = np.abs(size_a - size_b) <= most
        out[~near] = most[~near] + 1
        todo = np.flatnonzero(near)
    for block in _blocks(size_a[todo], size_b[todo]):
        mine = todo[block]
        found = _tables([a[k] for k in mine], [b[k] for k in mine], None if most is None else most[mine], free)
        out[mine] = found if most is None else np.minimum(found, most[mine] + 1)
    return out


def _tables(a: list[str], b: list[str], most: np.ndarray | None, free: bool) -> np.ndarray:
    """The last cells of the tables of some pairs, sorted by the length of a."""
    (x, size_a), (y, size_b) = _spelled(a), _spelled(b)
    n, width = y.shape
    place = np.arange(width + 1, dtype=np.int32)
    before = np.full((n, width + 1), _FAR, np.int32)
    last = np.broadcast_to(place, (n, width + 1)).astype(np.int32)
    out = np.where(size_a == 0, size_b, _FAR)
    who = np.flatnonzero(size_a > 0)  # the pairs still worked on
    before, last, x, y = before[who], last[who], x[who], y[who]
    if free:
        seen = np.zeros((len(who), width), np.int32)  # the last row with the character of this column
        kept = np.full((len(who), width), _FAR, np.int32)  # the cell before such a match
    band = max(x.shape[1], width) if most is None else int(most[who].max(initial=0))
    for i in range(1, x.shape[1] + 1):
        low, high = max(1, i - band), min(width, i + band)
        if low > high or not len(who):
            break
        here = slice(low - 1, high)
        match = y[:, here] == x[:, i - 1 : i]
        best = np.minimum(last[:, low - 1 : high] + ~match, last[:, low : high + 1] + 1)
        if free:
            j = place[low : high + 1]
            # a match to the left within the band; those further left are too far to matter
            left = np.zeros(match.shape, np.int32)
            left[:, 1:] = np.maximum.accumulate(np.where(match, j, 0), 1)[:, :-1]
            if low > 1:
                left[:, 0] = np.where(y[:, low - 2] == x[:, i - 1], low - 1, 0)
                left = np.maximum.accumulate(left, 1)
            row = seen[:, here]
            beside = (left > 0) & (left == j - 1) & (row > 0) & ~match
            best = np.where(beside, np.minimum(best, kept[:, here] + (i - row)), best)
            above = (row == i - 1) & (row > 0) & (left > 0) & ~match
            best = np.where(above, np.minimum(best, np.take_along_axis(before, np.maximum(left - 1, 0), 1) + (j - left)), best)
            shifted = np.full(match.shape, _FAR, np.int32)
            begin = 2 - low if low < 2 else 0
            shifted[:, begin:] = last[:, low + begin - 2 : high - 1]
            kept[:, here] = np.where(match, shifted, kept[:, here])
            seen[:, here] = np.where(match, i, row)
        elif i > 1:
            swap = (y[:, max(0, low - 2) : high - 1] == x[:, i - 1 : i]) & (y[:, max(1, low - 1) : high] == x[:, i - 2 : i - 1])
            part = best[:, best.shape[1] - swap.shape[1] :]
            np.copyto(part, np.minimum(part, before[:, max(2, low) - 2 : high - 1] + 1), where=swap)
        now = np.full((len(who), width + 1), _FAR, np.int32)
        now[:, low - 1] = i if low == 1 else _FAR
        now[:, low : high + 1] = best
        span = slice(low - 1, high + 1)
        now[:, span] = np.minimum.accumulate(now[:, span] - place[span], 1) + place[span]  # insertions
        done = size_a[who] == i
        out[who[done]] = now[done, size_b[who[done]]]
        stay = ~done
        if most is not None and i % 4 == 0:
            stay &= (now.min(1) <= most[who]) | (last.min(1) <= most[who])
        before, last = last, now
        if not stay.all():
            who, before, last, x, y = who[stay], before[stay], last[stay], x[stay], y[stay]
            if free:
                seen, kept = seen[stay], kept[stay]
    return out


def osa_many(a: list[str], b: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """Restricted edit distances: swaps of neighbours cost one, and nothing is edited twice."""
    return _edits(a, b, most, False)


def damerau_many(a: list[str], b: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """Unrestricted edit distances with swaps: text may be edited between the swapped characters."""
    return _edits(a, b, most, True)


def jaro_many(a: list[str], b: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """Jaro similarities, with whole pairs of transposed characters."""
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a))
    for mine in _blocks(size_a, size_b):
        (x, m), (y, n) = _spelled([a[k] for k in mine]), _spelled([b[k] for k in mine])
        window = np.maximum(0, np.maximum(m, n) // 2 - 1)
        place, rows = np.arange(y.shape[1]), np.arange(len(mine))
        free = place[None, :] < n[:, None]
        met = np.zeros(x.shape, bool)
        widest = int(window.max())
        for i in range(int(m.max())):
            low, high = max(0, i - widest), min(y.shape[1], i + widest + 1)
            if low >= high:
                break
            near = (y[:, low:high] == x[:, i : i + 1]) & free[:, low:high] & (np.abs(place[low:high] - i) <= window[:, None]) & (i < m)[:, None]
            first = near.argmax(1)
            found = near[rows, first]
            met[found, i] = True
            free[rows[found], low + first[found]] = False
        taken = (place[None, :] < n[:, None]) & ~free
        common = met.sum(1)
        swapped = np.bincount(np.nonzero(met)[0][x[met] != y[taken]], minlength=len(mine)) // 2
        some = common > 0
        c = common[some]
        out[mine[some]] = (c / m[some] + c / n[some] + (c - swapped[some]) / c) / 3
        out[mine[(m == n) & (m == 0)]] = 1.0
    return out


def batched(function: Callable[..., np.ndarray], kind: str, limited: bool = False) -> Callable[..., Column]:
    """A function of two texts, and of a limit if asked, over Arrow batches; null if any is null, each distinct pair of a batch once."""

    def of(left: pd.Series, right: pd.Series, most: pd.Series | None) -> pd.Series:
        whole = left.notna() & right.notna()
        if most is not None:
            whole &= most.notna()
        at = np.flatnonzero(whole)
        (ka, ua), (kb, ub) = pd.factorize(left.iloc[at]), pd.factorize(right.iloc[at])
        key = ka.astype(np.int64) * max(1, len(ub)) + kb
        limit = None
        if most is not None:
            kt, ut = pd.factorize(most.iloc[at].astype(np.int64))
            key = key * max(1, len(ut)) + kt
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        if most is not None:
            limit = np.asarray(ut, np.int64)[kt[first]]
        found = function([ua[k] for k in ka[first]], [ub[k] for k in kb[first]], limit)
        values = np.zeros(len(left), np.float64 if kind == "double" else np.int32)
        values[at] = found[back]
        return pd.Series(pd.array(values, "Float64" if kind == "double" else "Int32")).where(whole.to_numpy())

    def two(left: pd.Series, right: pd.Series) -> pd.Series:
        return of(left, right, None)

    def three(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
        return of(left, right, most)

    # made when it is called, as importing this module on an executor must not need a session
    return F.pandas_udf(three if limited else two, kind)


def pairwise(function: Callable[..., np.ndarray], kind: str) -> Callable[..., Column]:
    """The same as a function of columns."""
    return lambda *columns: batched(function, kind, len(columns) > 2)(*columns)


_osa, _damerau, _jaro = pairwise(osa_many, "int"), pairwise(damerau_many, "int"), pairwise(jaro_many, "double")


def _edited(function: Callable[..., Column], a: Column, b: Column, most: Column | None) -> Column:
    """The distance of what is not equal; with a limit, anything above it for what lies further apart in length."""
    asked = ~same(a, b)
    if most is None:
        return function(F.when(asked, norm(a)), F.when(asked, norm(b)))
    most = F.greatest(most.cast("int"), F.lit(0))
    gap = F.abs(F.length(norm(a)) - F.length(norm(b)))
    near = asked & (gap <= most)
    return F.coalesce(function(F.when(near, norm(a)), F.when(near, norm(b)), F.when(near, most)), F.greatest(gap, most + 1))


def osa_distance(a: Column | str, b: Column | str, most: Column | None = None) -> Column:
    """Optimal string alignment: Levenshtein with swaps of neighbours.  Distances above ``most`` may be given as anything above it."""
    a, b = text(a), text(b)
    return _with_nulls(a, b, _edited(_osa, a, b, most))


def damerau_levenshtein_distance(a: Column | str, b: Column | str, most: Column | None = None) -> Column:
    """Damerau-Levenshtein distance.  Distances above ``most`` may be given as anything above it."""
    a, b = text(a), text(b)
    return _with_nulls(a, b, _edited(_damerau, a, b, most))


def jaro_similarity(a: Column | str, b: Column | str, least: Column | None = None) -> Column:
    """Jaro similarity as decimal(9, 8); 1 for equal texts, 0 with any null.  Similarities that lengths keep below ``least`` may be given as 0."""
    a, b = text(a), text(b)
    asked = ~same(a, b)
    if least is not None:
        m, n = F.length(norm(a)), F.length(norm(b))
        asked &= (F.lit(2.0) + F.least(m, n) / F.greatest(m, n, F.lit(1))) / 3 >= least.cast("double") - 1e-6
    found = _jaro(F.when(asked, norm(a)), F.when(asked, norm(b)))
    return F.when(same(a, b), F.lit(1.0)).otherwise(F.coalesce(found, F.lit(0.0))).cast("decimal(9,8)")


def jaro_winkler_similarity(a: Column | str, b: Column | str, scaling: float = 0.1, max_prefix: int = 4, least: float | None = None) -> Column:
    """Jaro similarity raised for a shared beginning, without a threshold.  Similarities below ``least`` may be given as anything below it."""
    a, b = text(a), text(b)
    x, y, alike = norm(a), norm(b), F.lit(0)
    for k in range(max_prefix, 0, -1):
        equal = (F.length(x) >= k) & (F.length(y) >= k) & (F.substring(x, 1, k) == F.substring(y, 1, k))
        alike = F.when(alike == 0, F.when(equal, k).otherwise(0)).otherwise(alike)
    raised = scaling * F.coalesce(alike, F.lit(0))
    # how alike texts must be for their beginning to raise them to ``least``
    j = jaro_similarity(a, b, None if least is None or scaling * max_prefix >= 1 else (F.lit(least) - raised) / (1 - raised)).cast("double")
    return F.when(same(a, b), F.lit(1.0)).otherwise(j + raised * (1 - j)).cast("decimal(9,8)")
