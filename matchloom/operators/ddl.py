"""A script that recreates the schemata, functions, tables, data and views of the session's catalog.

The engine resolves names when an object is made, so each comes after those that it reads: the names in the parsed text of a view or function are
looked up as they were when it was made, and objects are sorted by that graph; what is free to come at any place keeps the order by kind
and name.  Objects that read each other in a circle cannot be made by a script, and an error names them.  A text that leaves its schema out is run with that schema in use.

Tables are told as the engine shows them, with comments, defaults, partitioning, properties and source format; their location is left out,
so that they can be made elsewhere.  A function made from a class is told in a comment, as the engine does not tell where the class is.  Kinds of objects that the engine does not keep (indexes, triggers, procedures and the like) are named in a comment.
"""

from __future__ import annotations

import datetime
import heapq
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: The most rows of a table that are written out.
MOST_ROWS = 1000
_ABSENT = ("check constraints", "primary keys", "unique constraints", "foreign keys", "triggers", "stored procedures", "indexes")


@dataclass(frozen=True)
class Definition:
    """kind is SC, FN, U, DT or V (schema, function, table, data, view), in the order in which they are created."""

    kind: str
    schema: str
    name: str | None
    text: str
    #: The schema that names without one belong to, and what the text reads, each as (schema, name).
    within: str | None = None
    reads: tuple[tuple[str, str], ...] = ()


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def literal(value: object) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"double('{value}')" if value != value or value in (float("inf"), float("-inf")) else f"{value!r}D"
    if isinstance(value, datetime.datetime):
        return f"timestamp'{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"date'{value.isoformat()}'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in value.items()) + ")"
    if hasattr(value, "asDict"):
        return "named_struct(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in value.asDict().items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(literal, value)) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def definitions(spark: SparkSession, schemata: Sequence[str] | None = None, tables: bool = True, data: bool = False, views: bool = True, functions: bool = True) -> list[Definition]:
    out: list[Definition] = []
    for schema in sorted(schemata if schemata is not None else [d.name for d in spark.catalog.listDatabases()]):
        out.append(Definition("SC", schema, None, f"CREATE SCHEMA IF NOT EXISTS {quoted(schema)}"))
        for t in sorted(spark.catalog.listTables(schema), key=lambda t: t.name):
            if t.isTemporary:
                continue
            name = quoted(schema, t.name)
            if t.tableType == "VIEW":
                if views:
                    facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
                    text, within = facts.get("View Text", ""), facts.get("View Catalog and Namespace", schema).split(".")[-1].strip("`")
                    out.append(Definition("V", schema, t.name, f"CREATE OR REPLACE VIEW {name} AS {text}", within, _names(spark, text, within)))
                continue
            if tables:
                out.append(Definition("U", schema, t.name, _table(spark, name)))
            if data:
                out.append(Definition("DT", schema, t.name, _data(spark.table(name), name)))
        if functions:
            out += _functions(spark, schema)
    return _ordered(out)


def _names(spark: SparkSession, text: str, within: str) -> tuple[tuple[str, str], ...]:
    """The relations and functions that a query names, as (schema, name) in lower case."""
    found: set[tuple[str, str]] = set()
    todo: list[object] = [json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON())]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            kind = node.get("class", "").rpartition(".")[2]
            if name := node.get({"UnresolvedRelation": "multipartIdentifier", "UnresolvedFunction": "nameParts", "UnresolvedTableValuedFunction": "name"}.get(kind, "")):
                *schema, last = name.lower().strip("[]").split(", ")
                found.add((schema[-1] if schema else within.lower(), last))
            todo += node.values()
        elif isinstance(node, list):
            todo += node
    return tuple(sorted(found))


def _ordered(found: list[Definition]) -> list[Definition]:
    """Each object after those that it reads, otherwise by kind, schema and name."""
    rank = {"SC": 1, "FN": 2, "U": 3, "DT": 4, "V": 14}
    found = sorted(found, key=lambda d: (rank[d.kind], d.schema, d.name or ""))
    makers: dict[tuple[str, str], list[int]] = {}
    for k, d in enumerate(found):
        if d.kind in ("FN", "U", "V"):
            makers.setdefault((d.schema.lower(), d.name.lower()), []).append(k)
    waits = [{k for name in d.reads for k in makers.get(name, ()) if k != at} for at, d in enumerate(found)]
    free = [k for k, w in enumerate(waits) if not w]
    out: list[int] = []
    while free:
        out.append(k := heapq.heappop(free))
        for at, w in enumerate(waits):
            if k in w:
                w.remove(k)
                if not w:
                    heapq.heappush(free, at)
    if len(out) < len(found):
        at, path = next(k for k, w in enumerate(waits) if w), []
        while at not in path:  # what waits, waits for something that waits
            path.append(at)
            at = min(waits[at])
        circle = path[path.index(at) :]
        raise ValueError("objects read each other in a circle: " + ", ".join(quoted(found[k].schema, found[k].name) for k in circle))
    return [found[k] for k in out]


def _table(spark: SparkSession, name: str) -> str:
    """As the engine shows it, for a table that may exist, without its location and with properties of its own only."""
    lines = spark.sql(f"SHOW CREATE TABLE {name}").first()[0].rstrip().split("\n")
    lines = [line for line in lines[1:] if not line.startswith("LOCATION ")]
    return "\n".join([f"CREATE TABLE IF NOT EXISTS {name} (", *lines])


def _functions(spark: SparkSession, schema: str) -> list[Definition]:
    """The schema's functions; of those of a class the engine does not tell where the class is."""
    out = []
    for row in spark.sql(f"SHOW USER FUNCTIONS IN {quoted(schema)}").collect():
        name = row[0].split(".")[-1].strip("`")
        told = [line for (line,) in spark.sql(f"DESCRIBE FUNCTION EXTENDED {quoted(schema, name)}").collect()]
        usage = next((line[len("Usage:") :] for line in told if line.startswith("Usage:")), "")
        try:
            every = json.loads(usage)
        except ValueError:
            every = {}
        facts = {k.removeprefix("sqlFunction."): v for k, v in every.items() if k.startswith("sqlFunction.")}
        if not facts:
            made_from = next((line[len("Class:") :].strip() for line in told if line.startswith("Class:")), "unknown")
            out.append(Definition("FN", schema, name, f"/* Function {quoted(schema, name)} is made from class {made_from.replace('*/', '* /')}. */"))
            continue
        within = every.get(f"catalogAndNamespace.part.{int(every.get('catalogAndNamespace.numParts', 0)) - 1}", schema)
        if body := facts.get("query") or facts.get("expression"):
            returns_table = facts.get("isTableFunc") == "true"
            kind = f"TABLE ({facts['returnType']})" if returns_table else facts["returnType"]
            reads = _names(spark, body if returns_table else f"SELECT {body}", within)
            out.append(Definition("FN", schema, name, f"CREATE OR REPLACE FUNCTION {quoted(schema, name)}({facts.get('inputParam', '')}) RETURNS {kind} RETURN {body}", within, reads))
    return out


def _data(df, name: str) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if not rows:
        return "/* Source table is empty. */"
    if len(rows) > MOST_ROWS:
        return f"/* Source table has more than {MOST_ROWS} rows. */"
    # in an order of their own, so that the script does not depend on files
    values = ",\n".join("\t(" + ", ".join(map(literal, r)) + ")" for r in sorted(rows, key=lambda r: [(x is not None, x if isinstance(x, (int, float, str)) else literal(x)) for x in r]))
    return f"INSERT INTO {name} ({', '.join(map(quoted, df.columns))})\nVALUES\n{values}"


def db_creator(spark: SparkSession, schemata: Sequence[str] | None = None, replace: bool = False, tables: bool = True, data: bool = False, views: bool = True, commit: bool = False, functions: bool = True) -> str:
    """The script; with ``replace`` what exists in these schemata is dropped first, with ``commit`` the script is run."""
    found = definitions(spark, schemata, tables, data, views, functions)
    drops = {"V": "VIEW", "FN": "FUNCTION", "U": "TABLE"}
    gone = [d for d in reversed(found) if replace and d.kind in drops and not d.text.startswith("/*")]
    statements = [f"DROP {drops[d.kind]} IF EXISTS {quoted(d.schema, d.name)}" for d in sorted(gone, key=lambda d: d.kind == "U")]
    before = now = spark.catalog.currentDatabase()
    for d in found:
        if d.reads and d.within and d.within != now:
            now = d.within
            statements.append(f"USE {quoted(now)}")
        statements.append(d.text)
    if now != before:
        statements.append(f"USE {quoted(before)}")
    if commit:
        for x in statements:
            if not x.startswith("/*"):
                spark.sql(x)
    return f"/* Not kept by this engine: {', '.join(_ABSENT)}. */\n" + "".join(x + (";\n" if not x.startswith("/*") else "\n") for x in statements)
