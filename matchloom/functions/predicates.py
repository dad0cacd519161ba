"""Threshold predicates (a, b, threshold) -> boolean that is never null, and their registry by name.

Thresholds are literals, so special cases are settled while the plan is built.  ``PREDICATES`` also tells
matching which rules are equalities (join keys) and which bound the difference in length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import distance
from .norm import norm, same, text

Number = int | float | str | Decimal


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(a: Column, b: Column) -> Column:
    return _sure(same(a, b))


def _size(c: Column) -> Column:
    return F.length(F.rtrim(c))


def exact(a: Column | str, b: Column | str, threshold: Number = 1) -> Column:
    """Equal texts; never with threshold 0."""
    return _equal(text(a), text(b)) if int(threshold) else F.lit(False)


def levenshtein(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Levenshtein distance up to the threshold."""
    a, b, t = text(a), text(b), int(threshold)
    if t <= 0:
        return _equal(a, b) if t == 0 else F.lit(False)
    near = F.levenshtein(norm(a), norm(b), t).between(0, t)
    return _one_null(a, b, t, near, F.lit(None).cast("boolean"))


def _one_null(a: Column, b: Column, t: Column | int, near: Column, empty_null: Column) -> Column:
    """The rule for nulls that integer thresholds share: a null matches texts no longer than the threshold."""
    gap = F.when(a.isNull(), _size(b) <= t).otherwise(F.when(_size(a) == 0, empty_null).otherwise(_size(a) <= t))
    return _sure(F.when(a.isNull() | b.isNull(), F.when(a.isNull() & b.isNull(), False).otherwise(gap)).otherwise(near))


def levenshtein_low(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """The same, with the gap in length tested first; a null matches an empty text either way."""
    a, b, t = text(a), text(b), int(threshold)
    if t <= 0:
        return _equal(a, b) if t == 0 else F.lit(False)
    return _low_levenshtein(a, b, t)


def _low_levenshtein(a: Column, b: Column, t: int) -> Column:
    near = F.when(F.abs(_size(a) - _size(b)) <= t, F.levenshtein(norm(a), norm(b), t) >= 0)
    return _one_null(a, b, t, near, F.lit(True))


def _normalised(a: Column, b: Column, threshold: Number, measure: Callable[[Column, Column, Column], Column]) -> Column:
    t = Decimal(str(threshold))
    if t <= 0:
        return _equal(a, b) if t == 0 else F.lit(False)
    if t >= 1:
        return F.lit(True)
    longer = F.when(_size(a) < _size(b), _size(b)).otherwise(_size(a))  # unknown for a null first text
    return _sure(measure(a, b, F.floor(F.lit(t) * longer)) <= F.lit(t) * longer)


def levenshtein_normalised(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Levenshtein distance up to the threshold times the longer length."""
    return _normalised(text(a), text(b), threshold, distance.levenshtein_distance)


def levenshtein_low_normalised(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """The same with the threshold cut to whole edits; a null first text matches everything but null."""
    a, b = text(a), text(b)
    return _low_normalised(a, b, threshold, lambda x, y, t: distance.levenshtein_distance(x, y) <= t)


def _low_normalised(a: Column, b: Column, threshold: Number, within: Callable[[Column, Column, Column], Column]) -> Column:
    longer = F.when(_size(a) < _size(b), _size(b)).otherwise(_size(a))
    # whole edits, cut towards zero; unknown for a null first text
    t = F.when(a.isNotNull(), (F.lit(Decimal(str(threshold))) * longer).cast("int"))
    return (
        F.when(t < 0, False)
        .when(a.isNull() & b.isNull(), False)
        .when(_equal(a, b), True)
        .when(t == 0, False)
        .when(a.isNull() | (_size(a) == 0), ~_sure(_size(b) > t))
        .when(b.isNull() | (_size(b) == 0), ~_sure(_size(a) > t))
        .when(F.abs(_size(a) - _size(b)) > t, False)
        .otherwise(_sure(within(a, b, t)))
    )


def osa(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Optimal string alignment distance up to the threshold."""
    return _sure(distance.osa_distance(a, b, F.lit(int(threshold))) <= int(threshold))


def osa_low(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """The same by a banded table, with the gap in length tested first."""
    a, b, t = text(a), text(b), int(threshold)
    if t <= 0:
        return _equal(a, b) if t == 0 else F.lit(False)
    near = distance.osa_distance(a, b, F.lit(t)) <= t
    return _one_null(a, b, t, near, F.lit(True))


def osa_normalised(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Optimal string alignment distance up to the threshold times the longer length."""
    return _normalised(text(a), text(b), threshold, distance.osa_distance)


def osa_low_normalised(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """The same with the threshold cut to whole edits; a null first text matches everything but null."""
    return _low_normalised(text(a), text(b), threshold, lambda x, y, t: distance.osa_distance(x, y, t) <= t)


def damerau_levenshtein(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Damerau-Levenshtein distance up to the threshold."""
    return _sure(distance.damerau_levenshtein_distance(a, b, F.lit(int(threshold))) <= int(threshold))


def damerau_levenshtein_normalised(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Damerau-Levenshtein distance up to the threshold times the longer length."""
    return _normalised(text(a), text(b), threshold, distance.damerau_levenshtein_distance)


def jaro(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Jaro similarity of at least the threshold."""
    return _sure(distance.jaro_similarity(a, b, F.lit(Decimal(str(threshold)))) >= Decimal(str(threshold)))


def jaro_winkler(a: Column | str, b: Column | str, threshold: Number) -> Column:
    """Jaro-Winkler similarity of at least the threshold."""
    return _sure(distance.jaro_winkler_similarity(a, b, least=float(threshold)) >= Decimal(str(threshold)))


PREDICATES: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (exact, levenshtein, levenshtein_low, levenshtein_normalised, levenshtein_low_normalised, osa, osa_low, osa_normalised, osa_low_normalised, damerau_levenshtein, damerau_levenshtein_normalised, jaro, jaro_winkler)
}
#: Rules that stay in the JVM, cheapest first; the others cross to Python.
NATIVE = ("exact", "levenshtein_low", "levenshtein", "levenshtein_low_normalised", "levenshtein_normalised")


def is_equality(name: str, threshold: Number) -> bool:
    """Whether the rule is plain equality, so that it can be a join key."""
    t = Decimal(str(threshold))
    return name == "exact" and int(t) != 0 or t == 0 and name in ("levenshtein", "levenshtein_low", "levenshtein_normalised", "osa_low", "osa_normalised", "damerau_levenshtein_normalised")


def longest_gap(name: str, threshold: Number) -> int | None:
    """How far apart the lengths of two texts that match can be, where the rule bounds it."""
    if name in ("levenshtein", "levenshtein_low", "osa", "osa_low", "damerau_levenshtein"):
        return math.floor(Decimal(str(threshold)))
    return None
