"""Tables from delimited text, and transposition.  Both have names of columns that depend on the data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows that may become columns.
MOST_COLUMNS = 10_000


def string_table_split(spark: SparkSession, string: str, separator: str = ",", row_separator: str = ";", header: bool = True) -> DataFrame:
    """The table that a text spells out; all columns are strings.  Rows must have as many items as the first."""
    first, *_ = string.split(row_separator)
    items = first.split(separator)
    names = items if header else [f"Column{k}" for k in range(1, len(items) + 1)]
    rows = spark.createDataFrame([(string,)], "s string").select(F.posexplode(F.split("s", re.escape(row_separator), -1)).alias("n", "line"))
    cells = rows.select("n", F.split("line", re.escape(separator), -1).alias("cells")).where(F.col("n") >= (1 if header else 0))
    checked = F.when(F.size("cells") == len(items), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("row with another number of items: "), F.col("n").cast("string"))).cast("array<string>"))
    return cells.orderBy("n").select(checked.alias("cells")).select(*(F.col("cells")[k].alias(name) for k, name in enumerate(names)))


def string_tables_split(rows: DataFrame, column: str, names: Sequence[str], separator: str = ",", row_separator: str = ";", header: bool = True) -> DataFrame:
    """The tables that the texts of a column spell out, one below the other: the other columns of each row, ``line`` (from 1, without the header) and ``names``.

    All texts have the same columns, which with a header they name themselves; a text with other names or another number of items is an error.
    Null texts have no lines.  It is a projection: no shuffle, and nothing leaves the JVM."""
    if clash := {*names, "line"} & {c for c in rows.columns if c != column} or len({*names, "line"}) <= len(names):
        raise ValueError(f"columns {sorted(clash) if isinstance(clash, set) else list(names)} are there twice")
    cells = lambda line: F.split(line, re.escape(separator), -1)
    others = [F.col(f"`{c}`") for c in rows.columns if c != column]
    lines = rows.select(*others, F.posexplode(F.split(F.col(f"`{column}`"), re.escape(row_separator), -1)).alias("__n", "__line"))
    found = lines.withColumn("__cells", cells(F.col("__line")))
    wrong = F.size("__cells") != len(names)
    if header:
        wrong |= (F.col("__n") == 0) & (F.col("__cells") != F.array(*map(F.lit, names)))
    told = F.raise_error(F.concat(F.lit("line with other names or another number of items: "), F.col("__line"))).cast("array<string>")
    found = found.withColumn("__cells", F.when(wrong, told).otherwise(F.col("__cells")))
    kept = F.filter(F.array("__cells"), lambda _: F.col("__n") >= (1 if header else 0))  # after the test, so that it is made for headers too
    found = found.select(*others, (F.col("__n") + (0 if header else 1)).alias("line"), F.explode(kept).alias("__cells"))
    return found.select(*others, "line", *(F.col("__cells")[k].alias(name) for k, name in enumerate(names)))


def transpose(df: DataFrame, include_labels: bool = True) -> DataFrame:
    """Rows become columns: names come from the first column, each further column becomes a row of strings; null reads ``NULL``.

    The label column carries the names of those columns, under the name of the first.
    """
    label, *rest = df.columns
    if not rest:
        raise ValueError("there must be a second column")
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = lambda c: F.coalesce(own(c).cast("string"), F.lit("NULL"))
    named = df.select(text(label).alias("__name"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), text(c).alias("v")) for k, c in enumerate(rest)))).alias("x"))
    names = [r[0] for r in df.select(text(label)).limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} rows cannot become columns")
    if len(set(names)) < len(names) or include_labels and label in names:
        raise ValueError("values of the first column repeat, so they cannot name columns")
    wide = named.groupBy(F.col("x.k").alias("__k"), F.col("x.c").alias("__c")).pivot("__name", names).agg(F.first("x.v"))
    shown = [F.col("__c").alias(label)] if include_labels else []
    return wide.orderBy("__k").select(*shown, *map(own, names))


def _quoted(text: str, mark: str = "'") -> str:
    """A SQL literal of the text."""
    return mark + text.replace("\\", "\\\\").replace(mark, "\\" + mark) + mark


def transpose_script(table: str, columns: Sequence[str], result: str, include_labels: bool = True) -> str:
    """What ``transpose`` does to a table of the catalog with these columns, as a SQL script for ``spark.sql``; it leaves the rows in the table ``result``, which it replaces.

    The script reads the names of columns from the rows when it runs, so it fits a table whose rows change.  They come in the order of the names, as rows of tables have none."""
    label, *rest = columns
    if not rest:
        raise ValueError("there must be a second column")
    q = lambda c: "`" + c.replace("`", "``") + "`"
    text = lambda c: f"coalesce(CAST({q(c)} AS STRING), 'NULL')"
    cells = ", ".join(f"named_struct('k', {k}, 'c', {_quoted(c)}, 'v', {text(c)})" for k, c in enumerate(rest))
    shown = f"`__c` AS {q(label)}, " if include_labels else ""
    source = f"SELECT {text(label)} AS `__name`, `__x`.k AS `__k`, `__x`.c AS `__c`, `__x`.v AS `__v` FROM {table} LATERAL VIEW explode(array({cells})) `__e` AS `__x`"
    name = "concat(chr(96), replace(n, chr(96), concat(chr(96), chr(96))), chr(96))"
    value = "concat(chr(39), replace(replace(n, chr(92), concat(chr(92), chr(92))), chr(39), concat(chr(92), chr(39))), chr(39))"
    return f"""BEGIN
  DECLARE names ARRAY<STRING>;
  DECLARE query STRING;
  SET names = (SELECT array_sort(collect_list({text(label)})) FROM {table});
  IF size(names) > {MOST_COLUMNS} THEN
    SELECT raise_error('more than {MOST_COLUMNS} rows cannot become columns');
  END IF;
  IF size(array_distinct(names)) < size(names){f" OR array_contains(names, {_quoted(label)})" if include_labels else ""} THEN
    SELECT raise_error('values of the first column repeat, so they cannot name columns');
  END IF;
  SET query = concat(
    {_quoted(f"CREATE TABLE {result} USING parquet AS SELECT {shown}")}, array_join(transform(names, n -> {name}), ', '),
    {_quoted(f" FROM ({source}) PIVOT (first(`__v`) FOR `__name` IN (")}, array_join(transform(names, n -> concat({value}, ' AS ', {name})), ', '), ')) ORDER BY `__k`');
  DROP TABLE IF EXISTS {result};
  EXECUTE IMMEDIATE query;
END"""
