"""Structure compliance: every row gets a text of its deviations from an expected structure.

The checks, in order: names and positions of columns (the same for all rows), conversion to the type, truncation,
missing data, duplicates within groups of columns.  All but the last are one projection.  For the last, keys are counted with partial aggregation and those that
repeat are written: with none of them nothing is joined, few are broadcast, and of many the most frequent are broadcast and bitmaps of hashes tell which
of the other rows have to move at all.  So rows whose key does not repeat are not shuffled, and a hot key is no hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .candidates import BROADCAST_BYTES
from .tables import size, written

ERROR = "__error__"
#: Bits of the bitmaps of keys that repeat (1 MB), and how many keys count as hot at most.
PLACES, HOT = 1 << 23, 1000

#: Names of types that Spark calls otherwise.
_KINDS = {"bit": "boolean", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "float": "double", "real": "float"}


@dataclass(frozen=True)
class Field:
    """An expected column.  ``unique`` is the number of its group of unique columns, from 1."""

    name: str
    datatype: str
    length: int | None = None
    scale: int | None = None
    nullable: bool = True
    unique: int | None = None
    datestyle: str | None = None

    @property
    def datatype_string(self) -> str:
        if self.datatype in ("decimal", "numeric"):
            return f"{self.datatype}({self.length}, {self.scale})"
        return f"{self.datatype}({self.length})" if self.datatype.endswith("char") and self.length else self.datatype

    def converted(self, column: Column) -> Column:
        """The value as the type; null if it cannot be converted."""
        if self.datatype.endswith("char"):
            whole = column.cast("string")
            return F.substring(whole, 1, self.length) if self.length else whole
        if self.datatype in ("decimal", "numeric"):
            return F.trim(column.cast("string")).try_cast(f"decimal({self.length},{self.scale})")
        kind = _KINDS.get(self.datatype, self.datatype)
        return (F.trim(column) if kind != "string" else column).try_cast(kind) if kind != "binary" else column.try_cast(kind)

    def converted_sql(self, column: str) -> str:
        """``converted`` of a column that SQL names."""
        if self.datatype.endswith("char"):
            whole = f"CAST({column} AS STRING)"
            return f"substring({whole}, 1, {self.length})" if self.length else whole
        if self.datatype in ("decimal", "numeric"):
            return f"try_cast(trim(CAST({column} AS STRING)) AS DECIMAL({self.length},{self.scale}))"
        kind = _KINDS.get(self.datatype, self.datatype)
        return f"try_cast({column if kind in ('binary', 'string') else f'trim({column})'} AS {kind})"


def fields_of(structure: T.StructType | Sequence[Field]) -> list[Field]:
    """Expected columns from a schema, or as given."""
    if not isinstance(structure, T.StructType):
        return list(structure)
    out = []
    for f in structure:
        kind = f.dataType
        if isinstance(kind, T.DecimalType):
            out.append(Field(f.name, "decimal", kind.precision, kind.scale, f.nullable))
        elif isinstance(kind, (T.VarcharType, T.CharType)):
            out.append(Field(f.name, kind.typeName(), kind.length, nullable=f.nullable))
        else:
            out.append(Field(f.name, kind.simpleString(), nullable=f.nullable))
    return out


def _reserved(name: str) -> bool:
    return len(name) >= 4 and name.startswith("__") and name.endswith("__")


def column_errors(expected: Sequence[Field], actual: Sequence[str]) -> str:
    """The text on names and positions; empty if all are in place."""
    places = {name: k for k, name in enumerate(actual, 1) if not _reserved(name)}
    found = []
    for k, field in enumerate(expected, 1):
        if field.name not in places:
            found.append(f"[{field.name}] is missing from position {k}")
        elif places[field.name] != k:
            found.append(f"[{field.name}] ({places[field.name]}) should be in position {k}")
    names = {f.name for f in expected}
    found += [f"[{name}] ({k}) is spurious" for name, k in places.items() if name not in names]
    return f"Column error: {', '.join(found)}. " if found else ""


def _place(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Bitmap and bit of a key."""
    place = F.pmod(F.xxhash64(*columns), F.lit(PLACES))
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def may_repeat(rows: DataFrame, twice: DataFrame, columns: Sequence[Column], keys: Sequence[Column], name: str) -> DataFrame:
    """The rows with a column that is true where the key may be one of ``twice``: bitmaps of hashes, 4 KB each, ``PLACES`` bits in all, are broadcast."""
    bucket, bit = _place(keys)
    maps = twice.select(bucket.alias("__bucket"), bit.alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    bucket, bit = _place(columns)
    rows = rows.withColumn("__bucket", bucket).withColumn("__bit", bit).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__map", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("__bit") % 8)), F.lit(2)) == 1
    return rows.withColumn(name, F.coalesce(held, F.lit(False))).drop("__bucket", "__bit", "__map")


def marked(rows: DataFrame, df: DataFrame, names: Sequence[str], mark: str) -> DataFrame:
    """The rows with ``mark``, true where ``df`` holds their key more than once and else null or false.

    Keys that repeat are counted and written.  Few are broadcast.  Of many, the most frequent (``HOT`` at most) are broadcast, and of the other rows
    only those move whose hash is that of a key that repeats."""
    spark = df.sparkSession
    counted = df.groupBy(*(F.col(f"`{n}`").alias(f"__u{k}") for k, n in enumerate(names))).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    seen = Observation()
    twice, path = written(counted.observe(seen, F.count(F.lit(1)).alias("keys"), F.sum("__n").alias("rows")), "repeated")
    keys, total = seen.get["keys"], seen.get["rows"]
    if not keys:
        return rows.withColumn(mark, F.lit(False))
    columns = [F.col(f"`{n}`") for n in names]

    def joined(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        right = right.drop("__n").withColumn(name, F.lit(True))
        same = None
        for k, n in enumerate(names):
            part = left[f"`{n}`"].eqNullSafe(right[f"__u{k}"])
            same = part if same is None else same & part
        return left.join(right, same, "left").drop(*(f"__u{k}" for k in range(len(names))))

    if size(spark, path) <= BROADCAST_BYTES:
        return joined(rows, F.broadcast(twice), mark)
    hot = F.col("__n") * HOT > total
    near = joined(rows, F.broadcast(twice.where(hot)), "__hot")
    asked = may_repeat(near, twice.where(~hot), columns, [F.col(f"__u{k}") for k in range(len(names))], "__may")
    away = F.col("__hot").isNull() & F.col("__may")
    stay = asked.where(~away).withColumn(mark, F.col("__hot"))
    return stay.unionByName(joined(asked.where(away), twice.where(~hot), mark)).drop("__hot", "__may")


def structure_compliance(df: DataFrame, structure: T.StructType | Sequence[Field], truncation_check: bool = True) -> DataFrame:
    """The rows with a column ``__error__``, empty for rows without deviation."""
    expected = fields_of(structure)
    if not expected:
        raise ValueError("No structure found to apply.")
    if ERROR in df.columns:
        raise ValueError(f"the table has a column {ERROR}")
    present = [f for f in expected if f.name in df.columns]
    parts: list[Column] = [F.lit(column_errors(expected, df.columns))]
    for f in present:
        column, value = F.col(f"`{f.name}`"), f.converted(F.col(f"`{f.name}`"))
        style = f" using datestyle {f.datestyle}" if f.datestyle else ""
        check = F.when(value.isNull(), f"Datatype error: [{f.name}] could not be converted to {f.datatype_string}{style}. ")
        if truncation_check:
            shorter = F.length(F.rtrim(value.cast("string"))) < F.length(F.rtrim(column.cast("string")))
            check = check.when(shorter, f"Truncation error: [{f.name}] would be truncated when converted to {f.datatype_string}{style}. ")
        parts.append(F.when(column.isNotNull(), F.coalesce(check.otherwise(""), F.lit(""))).otherwise(""))
    for f in present:
        if not f.nullable:
            parts.append(F.when(F.col(f"`{f.name}`").isNull(), f"Nullability error: [{f.name}] does not contain data. ").otherwise(""))
    groups: dict[int, list[str]] = {}
    for f in present:
        if f.unique:
            groups.setdefault(f.unique, []).append(f.name)
    out, marks = df, []
    for number, names in sorted(groups.items()):
        mark = f"__unique_{number}"
        out = marked(out, df, names, mark)
        marks.append(mark)
        listed = ", ".join(f"[{n}]" for n in names)
        parts.append(F.when(F.col(mark), f"Uniqueness error: ({listed}) contains duplicates. ").otherwise(""))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.concat(*parts).alias(ERROR))


def compliance_script(table: str, columns: Sequence[str], structure: T.StructType | Sequence[Field], result: str, truncation_check: bool = True) -> str:
    """What ``structure_compliance`` does to a table of the catalog with these columns, as a SQL script for ``spark.sql``; it leaves the rows in the table ``result``, which it replaces.

    Keys that repeat are counted and joined back, so Spark chooses by their size how."""
    expected = fields_of(structure)
    if not expected:
        raise ValueError("No structure found to apply.")
    if ERROR in columns:
        raise ValueError(f"the table has a column {ERROR}")
    name = lambda c: "`" + c.replace("`", "``") + "`"
    told = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    present = [f for f in expected if f.name in columns]
    parts = [told(column_errors(expected, columns))]
    for f in present:
        column = f"t.{name(f.name)}"
        value, style = f.converted_sql(column), f" using datestyle {f.datestyle}" if f.datestyle else ""
        checks = f"WHEN {column} IS NULL THEN '' WHEN {value} IS NULL THEN {told(f'Datatype error: [{f.name}] could not be converted to {f.datatype_string}{style}. ')}"
        if truncation_check:
            shorter = f"length(rtrim(CAST({value} AS STRING))) < length(rtrim(CAST({column} AS STRING)))"
            checks += f" WHEN {shorter} THEN {told(f'Truncation error: [{f.name}] would be truncated when converted to {f.datatype_string}{style}. ')}"
        parts.append(f"CASE {checks} ELSE '' END")
    parts += [f"if(t.{name(f.name)} IS NULL, {told(f'Nullability error: [{f.name}] does not contain data. ')}, '')" for f in present if not f.nullable]
    groups: dict[int, list[str]] = {}
    for f in present:
        if f.unique:
            groups.setdefault(f.unique, []).append(f.name)
    twice, joins = [], []
    for number, names in sorted(groups.items()):
        keys = [name(n) for n in names]
        twice.append(f"`__u{number}` AS (SELECT {', '.join(keys)}, true AS `__twice` FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1)")
        joins.append(f"\n    LEFT JOIN `__u{number}` ON {' AND '.join(f't.{k} <=> `__u{number}`.{k}' for k in keys)}")
        listed = ", ".join(f"[{n}]" for n in names)
        parts.append(f"if(`__u{number}`.`__twice`, {told(f'Uniqueness error: ({listed}) contains duplicates. ')}, '')")
    first = f"WITH {', '.join(twice)}\n    " if twice else ""
    errors = ",\n      ".join(parts)
    return f"""BEGIN
  DROP TABLE IF EXISTS {result};
  CREATE TABLE {result} USING parquet AS
    {first}SELECT t.*, concat(
      {errors}) AS `{ERROR}`
    FROM {table} AS t{"".join(joins)};
END"""
