"""Result sets as one cell of HTML.  Rows are sorted, numbered and turned into text where they lie; the cell is joined last, by one task, as it is one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import gradient_hex
from .numbering import order_by, sort_columns, with_row_number

#: The colours of the coloured table.
MAIN, BLACK, WHITE, DARK_ACCENT, LIGHT_ACCENT, GREY = "#181848", "#000000", "#ffffff", "#541b8c", "#72abe3", "#cfcfcf"
NEGATIVE, NULL, POSITIVE = "#8c1b1b", "#8c8c1b", "#1b8c1b"


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _numbered(df: DataFrame, order: str | Column | list | None) -> DataFrame:
    """Rows numbered from 0 in the order asked, ties by all columns."""
    sort = sort_columns(order_by(order)) + [F.col(f"`{c}`").cast("string").asc() for c in df.columns]
    return with_row_number(df, "__n", sort).withColumn("__n", F.col("__n") - 1)


def _joined(rows: DataFrame) -> DataFrame:
    """One row: the texts ``__row`` joined in order, null if there are none."""
    listed = F.array_sort(F.collect_list(F.struct("__n", "__row")))
    return rows.agg(F.nullif(F.array_join(F.transform(listed, lambda x: x["__row"]), ""), F.lit("")).alias("body"))


def select_to_html(df: DataFrame, order_by: str | Column | list | None = None) -> DataFrame:
    """One row, one column ``html``; null for an empty table.  Nulls show as nothing in text and 0 in numbers."""
    head = "".join(f'\t\t<th style="border:2px solid;text-align:center">{c}</th>\n' for c in df.columns)
    cells = []
    for c in df.columns:
        number = _is_number(df, c)
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0" if number else ""))
        cells += [F.lit(f'\t\t<td style="border:2px solid;text-align:{"right" if number else "left"}">'), value, F.lit("</td>\n")]
    rows = _numbered(df, order_by).select("__n", F.concat(F.lit("\t<tr>\n"), *cells, F.lit("\t</tr>\n")).alias("__row"))
    start = f'<table style="font-size:.9em;font-family:Verdana,Sans-Serif;border:3px solid;border-collapse:collapse">\n\t<tr>\n{head}\t</tr>\n'
    return _joined(rows).select(F.concat(F.lit(start), "body", F.lit("</table>")).alias("html"))


def _cell(background: Column | str, colour: str, align: str, value: Column | str, more: str = "") -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(f'\t\t<td style="border:2px solid {BLACK};background-color:'), lit(background), F.lit(f";color:{colour};text-align:{align}{more}\">"), lit(value), F.lit("</td>\n")]


def select_to_html_colour(df: DataFrame, order_by: str | Column | list | None = None, sum: bool = False) -> DataFrame:
    """The table in colours: numbers shaded between their least and greatest, a total row if asked.  One row, one column ``html``."""
    first, *rest = df.columns
    numbers = [c for c in rest if _is_number(df, c)]
    facts = [f(f"`{c}`").cast("double").alias(f"__{k}{i}") for i, c in enumerate(numbers) for k, f in (("min", F.min), ("max", F.max))]
    totals = [F.sum(f"`{c}`").alias(f"__sum{i}") for i, c in enumerate(numbers)]
    bounds = df.agg(F.count(F.lit(1)).alias("__count"), *facts, *totals)
    rows = _numbered(df, order_by if order_by is not None else [F.col(f"`{first}`")]).crossJoin(F.broadcast(bounds))  # one row of bounds
    shown = lambda c: F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), "\n", F.lit("")), F.lit(""))
    cells = _cell(DARK_ACCENT, WHITE, "center", shown(first))
    for c in rest:
        if c not in numbers:
            cells += _cell(F.when(F.col("__n") % 2 == 0, WHITE).otherwise(GREY), BLACK, "center", shown(c))
            continue
        i, value = numbers.index(c), F.col(f"`{c}`").cast("double")
        low, high = F.col(f"__min{i}"), F.col(f"__max{i}")
        signed = F.when(value < 0, gradient_hex(value, low, 0.0, NEGATIVE, NULL)).otherwise(gradient_hex(value, high, 0.0, POSITIVE, NULL))
        light = F.concat(*_cell(F.coalesce(signed, F.lit("")), WHITE, "right", shown(c)))
        dark = F.concat(*_cell(F.coalesce(gradient_hex(value, low, high, WHITE, LIGHT_ACCENT), F.lit("")), BLACK, "right", shown(c)))
        cells.append(F.when(low < 0, light).otherwise(dark))
    body = _joined(rows.select("__n", F.concat(F.lit("\t<tr>\n"), *cells, F.lit("\t</tr>\n")).alias("__row")))
    head = f'</th>\n\t\t<th style="background-color:{MAIN};border:2px solid {BLACK};text-align:center">'.join(df.columns)
    start = (
        f'<table style="font-size:.9em;font-family:Verdana,Sans-Serif;border:3px solid {BLACK};border-collapse:collapse">\n'
        f'\t<tr style="color:{WHITE}">\n\t\t<th style="background-color:{MAIN};border:2px solid {BLACK};text-align:center">{head}</th>\n\t</tr>\n'
    )
    total: list[Column] = []
    if sum:
        total = [F.lit("\t<tr>\n"), *_cell(DARK_ACCENT, WHITE, "center", "Total", ";font-style:italic")]
        for c in rest:
            if c not in numbers:
                total += _cell(BLACK, BLACK, "center", "")
                continue
            i = numbers.index(c)
            value = F.col(f"__sum{i}")
            shade = F.concat(*_cell(F.when(value < 0, NEGATIVE).otherwise(POSITIVE), WHITE, "right", F.coalesce(value.cast("string"), F.lit("")), ";font-style:italic"))
            plain = F.concat(*_cell(LIGHT_ACCENT, BLACK, "right", F.coalesce(value.cast("string"), F.lit("")), ";font-style:italic"))
            total.append(F.when(F.col(f"__min{i}") < 0, shade).otherwise(plain))
        total.append(F.lit("\t</tr>\n"))
    return body.crossJoin(bounds).select(F.concat(F.lit(start), F.coalesce("body", F.lit("")), *total, F.lit("</table>")).alias("html"))
