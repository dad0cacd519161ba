"""Global row numbers without moving all rows to one task, and orders from text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import size, written

_INDEX_BITS = 33  # as monotonically_increasing_id lays out its values


def order_by(priority: str | Column | Sequence[str | Column] | None) -> list[tuple[Column, bool]]:
    """Values to sort by, and whether each falls, from text such as ``a ASC, coalesce(b, 0) DESC``, columns (rising), or a list of either."""
    if priority is None:
        return []
    if isinstance(priority, Column):
        return [(priority, False)]
    if isinstance(priority, str):
        return [_sort(x) for x in _top_level(priority)]
    return [c for item in priority for c in order_by(item)]


def sort_columns(pairs: Sequence[tuple[Column, bool]]) -> list[Column]:
    return [c.desc() if falls else c.asc() for c, falls in pairs]


def _top_level(text: str) -> list[str]:
    """Parts of a list at commas that stand in no brackets or quotes."""
    out, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()[]":
            depth += 1 if c in "([" else -1
        if c == "," and not depth and not quote:
            out.append(part)
            part = ""
        else:
            part += c
    return [x for x in (*out, part) if x.strip()]


def _sort(item: str) -> tuple[Column, bool]:
    match = re.fullmatch(r"\s*(.*?)(?:\s+(asc|desc))?\s*", item, re.I | re.S)
    return F.expr(match[1]), (match[2] or "").lower() == "desc"


def row_numbers(df: DataFrame, name: str, order: Sequence[Column]) -> tuple[DataFrame, int, int]:
    """Rows numbered from 1 by ``order``, which should be total; how many they are, and the bytes of the table that holds them.

    Rows are range-sorted; each task numbers its own rows, and the counts of the tasks before it are added: what reaches the
    driver is one count for each partition.
    """
    spark = df.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(ways, *order).sortWithinPartitions(*order)
    placed, path = written(keyed.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _INDEX_BITS)
    held, total = dict(placed.groupBy(part.cast("int").alias("p")).count().collect()), 0
    before = []
    for p in range(max(held, default=0) + 1):
        before.append(total)
        total += held.get(p, 0)
    index = F.col("__at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    offset = F.element_at(F.expr(f"array({', '.join(f'{n}L' for n in before)})"), part.cast("int") + 1)  # as many as partitions
    return placed.withColumn(name, offset + index + 1).drop("__at"), total, size(spark, path)


def with_row_number(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """Rows numbered from 1 by ``order``."""
    return row_numbers(df, name, order)[0]
