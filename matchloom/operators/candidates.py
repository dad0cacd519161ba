"""Pairs of distinct values that may satisfy a rule, without forming all pairs of a group.

Edit distances.  Texts within t edits share a piece: the shorter is cut into t + 1 even pieces (2 t + 1 where a swap is one edit, as it can
touch two of them), of which one survives in the longer, moved by no more than the edits on either side of it allow.  Pieces of the shorter are an
inverted index by length, place and piece; the longer looks up the substrings in reach.  Thresholds that are a share of the longer
length give a number of edits for each length of the longer side.

Jaro similarities.  m characters in common bound the similarity by (m / |a| + m / |b| + 1) / 3, so a threshold asks for so many in common.  The characters of
a text, numbered among their like and rarest first, are an ordered bag: two bags with c in common share one of the first
|a| - c + 1 and |b| - c + 1.  Those are joined by an inverted index for each pair of lengths, then the whole bags are counted.
Where lengths leave at most one character of each text without a partner, texts meet by what they have in common as a whole: the
same bag, or the same rest after one character is taken away; the rest keeps its order if the threshold allows no transposition.

Values that are equal under the collation are always a pair.  Groups of few values and texts too short for pieces of two
characters are paired by length alone.  A list of the index with more than ``SLICE`` values is split into slices that the other side meets one by one.
Every pair that the rule accepts is among the candidates; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.norm import COLLATION, norm
from .tables import size, written

#: Values of a list, or records of a value, that one task pairs at a time.
SLICE = 512
#: Distinct values of a group that are paired by length alone, where the rule runs in the JVM and in Python.
PLAIN, PLAIN_IN_PYTHON = 512, 64
#: Tables up to this many bytes are broadcast.
BROADCAST_BYTES = 8 << 20
#: Frequent characters whose order is by count; all others come before them.
COUNTED = 256


@dataclass(frozen=True)
class Edits:
    """At most ``most`` edits, or floor(``share`` * longer length); swaps of neighbours count once if ``swaps``."""

    most: int = 0
    share: Decimal | None = None
    swaps: bool = False

    def within(self, longer: Column) -> Column:
        return F.lit(self.most) if self.share is None else F.floor(F.lit(self.share) * longer).cast("int")

    def pieces(self, longer: Column) -> Column:
        return self.within(longer) * (2 if self.swaps else 1) + 1

    def longest(self, shorter: Column) -> Column:
        """No text longer than this is within reach of one of the length."""
        return shorter + self.most if self.share is None else F.floor(shorter / F.lit(1 - self.share)).cast("int") + 1

    def gap(self, shorter: Column, longer: Column) -> Column:
        return longer - shorter <= self.within(longer)


@dataclass(frozen=True)
class Bags:
    """Jaro similarity of at least ``least``."""

    least: float

    def common(self, shorter: Column, longer: Column) -> Column:
        """How many characters both must have, at least."""
        return F.ceil(F.lit(3 * self.least - 1) * shorter * longer / F.greatest(shorter + longer, F.lit(1)) - 1e-6).cast("int")

    def longest(self, shorter: Column) -> Column:
        return F.floor(shorter / F.lit(3 * self.least - 2) + 1e-6).cast("int")

    def gap(self, shorter: Column, longer: Column) -> Column:
        return longer <= self.longest(shorter)

    def close(self, shorter: Column, longer: Column) -> Column:
        """Whether at most one character of either is not in common."""
        return longer - self.common(shorter, longer) <= 1

    def in_order(self, shorter: Column, longer: Column) -> Column:
        """Whether the characters in common must stand in the same order, if one of the longer text is not among them."""
        m = longer - 1
        transposed = F.floor(m * (1 - 3 * self.least + m / F.greatest(shorter, F.lit(1)) + m / F.greatest(longer, F.lit(1))) + 1e-6)
        return transposed < 1  # single characters out of place come in twos


def filter_of(function: str, threshold: str) -> Edits | Bags | None:
    """How candidates of a rule are found; None where its threshold excludes next to nothing."""
    t = Decimal(threshold)
    if function in ("jaro", "jaro_winkler"):
        # similarities have eight decimals; a shared beginning of four characters lifts by four tenths of what is missing
        least = float(t) - 1e-7 if function == "jaro" else (float(t) - 0.4) / 0.6 - 1e-7
        return Bags(least) if 0.67 < least <= 1 else None
    swaps = function.startswith(("osa", "damerau"))
    if function.endswith("normalised"):
        return Edits(share=t, swaps=swaps) if 0 < t < 1 else None
    if function.startswith(("levenshtein", "osa", "damerau")) and t >= 0:
        return Edits(math.floor(t), swaps=swaps)
    return None


def sliced(left: DataFrame, right: DataFrame, keys: Sequence[str], each: str, counts: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on the keys with another key, ``slice``: keys that the left holds more than ``SLICE`` times are dealt by ``each`` there and repeated on the right.

    ``counts`` has the keys and n, how often the left holds them; ``most`` is the largest n, if that is known."""
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if (most if most is not None else counts.agg(F.max("n")).first()[0] or 0) <= SLICE:
        return left.withColumn("slice", F.lit(0)), right.withColumn("slice", F.lit(0))
    many, path = written(counts.where(F.col("n") > SLICE).select(*keys, F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "slices")
    if size(left.sparkSession, path) <= BROADCAST_BYTES:
        many = F.broadcast(many)
    left, right = (side.join(many, list(keys), "left").withColumn("slices", F.coalesce("slices", F.lit(1))) for side in (left, right))
    dealt = F.pmod(F.xxhash64(each), F.col("slices")).cast("int")
    return left.withColumn("slice", dealt).drop("slices"), right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")


def _cut(length: Column, pieces: Column, i: Column) -> Column:
    """Where piece i of a text starts."""
    return F.floor(i * length / pieces).cast("int")


def _up_to(start: Column, stop: Column) -> Column:
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def _piece(x: Column, length: Column, pieces: Column, i: Column, at: Column) -> Column:
    return F.xxhash64(length, pieces, i, F.substring(x, at + 1, _cut(length, pieces, i + 1) - _cut(length, pieces, i)))


def _index_of_pieces(edits: Edits) -> Column:
    x, n = F.col("x"), F.col("size")
    numbers = F.array_distinct(F.transform(_up_to(n, edits.longest(n)), lambda s: edits.pieces(s))) if edits.share is not None else F.array(edits.pieces(n))
    usable = F.filter(numbers, lambda k: n >= 2 * k)
    return F.flatten(F.transform(usable, lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: _piece(x, n, k, i, _cut(n, k, i)))))


def _probes_of_pieces(edits: Edits) -> Column:
    x, n = F.col("x"), F.col("size")
    most, k = edits.within(n), edits.pieces(n)

    def places(length: Column, i: Column) -> Column:
        grown, start = n - length, _cut(length, k, i)
        play = F.floor((most - grown) / 2).cast("int")
        last = n - (_cut(length, k, i + 1) - start)
        return F.transform(_up_to(F.greatest(start - play, F.lit(0)), F.least(start + grown + play, last)), lambda at: _piece(x, length, k, i, at))

    return F.flatten(F.transform(_up_to(F.greatest(n - most, 2 * k), n), lambda length: F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda i: places(length, i)))))


def _bag(x: Column, order: dict[str, int]) -> Column:
    """The characters, numbered among their like, rarest first."""
    letters = F.split(x, "")
    rank = F.create_map(*(F.lit(y) for pair in order.items() for y in pair)) if order else F.create_map(F.lit(""), F.lit(0))

    def numbered(all_letters: Column) -> Column:
        one = lambda c, i: F.struct(F.coalesce(F.element_at(rank, c), F.lit(-1)).alias("r"), c.alias("c"), F.size(F.filter(F.slice(all_letters, 1, i + 1), lambda d: d == c)).alias("n"))
        return F.transform(F.array_sort(F.transform(all_letters, one)), lambda y: F.concat(y["c"], y["n"].cast("string")))

    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.array(letters), numbered)[0])


def _heads(bags: Bags, longer: bool) -> Column:
    """Tokens of the first characters of the bag, for each length of the other side."""
    n, bag = F.col("size"), F.col("bag")
    others = _up_to(F.floor(n * (3 * bags.least - 2) - 1e-6).cast("int") + 1, n) if longer else _up_to(n, bags.longest(n))

    def tokens(other: Column) -> Column:
        a, b = (other, n) if longer else (n, other)
        return F.transform(F.slice(bag, 1, F.greatest(n - bags.common(a, b) + 1, F.lit(0))), lambda c: F.xxhash64(a, b, c))

    far = lambda other: ~(bags.close(other, n) if longer else bags.close(n, other))
    return F.flatten(F.transform(F.filter(others, far), tokens))


def _rests(bags: Bags, longer: bool) -> Column:
    """Tokens of the whole text, and of what stays of it without one character, for the lengths that leave no more without a partner."""
    x, n, letters = F.col("x"), F.col("size"), F.col("letters")
    none = F.array().cast("array<bigint>")

    def kind(a: Column, b: Column) -> Column:
        """What is alike of texts that meet, told once for a text: its form, and a seed for these lengths."""
        ordered = bags.in_order(a, b)
        return F.struct(F.when(ordered, x).otherwise(letters).alias("form"), F.xxhash64(a, b, ordered).alias("seed"))

    def without_one(a: Column, b: Column) -> Column:
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        rests = lambda k: F.transform(places, lambda i: F.xxhash64(k["seed"], F.concat(F.substring(k["form"], F.lit(1), i - 1), F.substring(k["form"], i + 1, n))))
        return F.transform(F.array(kind(a, b)), rests)[0]

    same = F.when(bags.close(n, n), F.array(F.xxhash64(n, n, letters))).otherwise(none)
    replaced = F.when(bags.close(n, n) & (bags.common(n, n) < n), without_one(n, n)).otherwise(none)
    if longer:
        grown = F.when((n > 0) & bags.close(n - 1, n), without_one(n - 1, n)).otherwise(none)
    else:
        grown = F.when(bags.close(n, n + 1), F.transform(F.array(kind(n, n + 1)), lambda k: F.xxhash64(k["seed"], k["form"]))).otherwise(none)
    return F.concat(same, replaced, grown)


def candidates(values: DataFrame, keys: Sequence[str], how: Edits | Bags, native: bool, largest: int | None = None) -> DataFrame:
    """``keys``, a and b, in order, for all pairs of a group's distinct ``value`` that may satisfy the rule, each value with itself too.

    ``largest`` is the number of values of the largest group, if that is known.  The values are read several times."""
    spark, keys = values.sparkSession, list(keys)
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = values.select(*keys, "value", norm(F.col("value")).alias("x")).withColumn("size", F.length("x"))
    plain, counts = PLAIN if native else PLAIN_IN_PYTHON, values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    some = (largest if largest is not None else counts.agg(F.max("n")).first()[0] or 0) > plain
    if some:
        large, path = written(counts.where(F.col("n") > plain).select(*keys, F.lit(True).alias("large")), "large")
        large = F.broadcast(large) if size(spark, path) <= BROADCAST_BYTES else large
        rows = rows.join(large, keys, "left").withColumn("large", F.coalesce("large", F.lit(False)))
        if isinstance(how, Bags):
            order = [r[0] for r in rows.where("large").select(F.explode(F.split("x", "")).alias("c")).groupBy("c").count().orderBy("count", "c", ascending=[False, True]).limit(COUNTED).collect()]
            rows = rows.withColumn("letters", F.when(F.col("large"), F.array_join(F.array_sort(F.split("x", "")), "")))
            rows = rows.repartition(ways, *keys, "value")
            rows, _ = written(rows.withColumn("bag", F.when(F.col("large"), _bag(F.col("x"), {c: -k for k, c in enumerate(order)}))), "bags")
    else:
        rows = rows.withColumn("large", F.lit(False))

    def paired(a: DataFrame, b: DataFrame, on: list[str], more: Sequence[str] = ()) -> DataFrame:
        """Pairs of a shorter text and a longer one, in a fixed order where they are as long."""
        left, right = (side.select(*on, *(F.col(c).alias(f"{c}_{name}") for c in ("value", "size", *more))) for name, side in (("a", a), ("b", b)))
        ordered = (F.col("size_a") < F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("value_a") < F.col("value_b"))
        return left.repartition(ways, *on).join(right, on).where(ordered & how.gap(F.col("size_a"), F.col("size_b")))

    found = [paired(few := rows.where(~F.col("large")), few, keys)]
    alike = [c.withColumn("same", F.collate("value", COLLATION)) for c in (rows, rows)]
    same = alike[0].select(*keys, "same", F.col("value").alias("value_a")).join(alike[1].select(*keys, "same", F.col("value").alias("value_b")), [*keys, "same"]).where("value_a <= value_b")
    if some:
        # tokens cost much more than the texts they are made of
        many = rows.where("large").repartition(ways, *keys, "value")
        if isinstance(how, Edits):
            short_a, short_b = many.where(F.col("size") < 2 * how.pieces(how.longest(F.col("size")))), many.where(F.col("size") - how.within(F.col("size")) < 2 * how.pieces(F.col("size")))
            short = paired(*sliced(short_a, short_b, keys, "value"), [*keys, "slice"]).where(F.col("size_a") < 2 * how.pieces(F.col("size_b")))
            found.append(short)
            looked = [(_index_of_pieces(how), _probes_of_pieces(how), [])]
        else:
            looked = [(_rests(how, False), _rests(how, True), []), (_heads(how, False), _heads(how, True), ["bag"])]
        for tokens, probed, more in looked:
            index, probes = (many.select(*keys, "value", "size", *more, F.explode(F.array_distinct(t)).alias("token")) for t in (tokens, probed))
            met = paired(*sliced(index, probes, [*keys, "token"], "value"), [*keys, "token", "slice"], more)
            if more:
                met = met.where(F.size(F.array_intersect("bag_a", "bag_b")) >= how.common(F.col("size_a"), F.col("size_b")))
            found.append(met)
    out = same.select(*keys, "value_a", "value_b")
    for one in found:
        out = out.unionByName(one.select(*keys, "value_a", "value_b"))
    # what follows costs more than its rows tell, so tasks are not merged for being small
    return out.select(*keys, F.least("value_a", "value_b").alias("a"), F.greatest("value_a", "value_b").alias("b")).repartition(ways, *keys, "a", "b").distinct()


def near(values: DataFrame, keys: Sequence[str], function: str, threshold: str, how: Edits | Bags, native: bool, largest: int | None = None) -> DataFrame:
    """``keys``, a and b for all ordered pairs of a group's values that satisfy the rule."""
    holds = predicates.PREDICATES[function]
    found = candidates(values, keys, how, native, largest)
    both = lambda df: df.select(*keys, F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("p")).select(*keys, "p.a", "p.b")
    if isinstance(how, Edits):  # the same both ways
        return both(found.where(holds(F.col("a"), F.col("b"), threshold)))
    return both(found).where(holds(F.col("a"), F.col("b"), threshold))
