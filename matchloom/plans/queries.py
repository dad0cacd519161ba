"""One query for each function and operator over whole tables, and the same in DuckDB's SQL where it can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.predicates import PREDICATES
from ..functions.strings import MINOR_WORDS
from ..operators import Field, definitions, match, printed_parts, report, select_to_html, select_to_html_colour, string_tables_split, structure_compliance, transpose
from ..sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return keep


# strings, dates, colours, JSON


@_add("age", "SELECT o_orderkey, (strftime(DATE '2024-02-28', '%Y%m%d')::INT - strftime(o_orderdate, '%Y%m%d')::INT) // 10000 AS years FROM orders")
def age(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.age("o_orderdate", date(2024, 2, 28)).alias("years"))


@_add("extract_param", "SELECT page_id, CASE WHEN contains(url, 'page=') THEN regexp_extract(url, 'page=([^&]*)', 1) END AS page, CASE WHEN contains(url, 'page=') THEN regexp_extract(url, 'page=[^&]*') END AS pair FROM pages")
def extract_param(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.extract_param("url", "page=", "&").alias("page"), fn.extract_param("url", "page=", "&", include_key=True).alias("pair"))


@_add("extract_pattern", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def extract_pattern(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.extract_pattern("c_name", "[0-9]").alias("digits"))


@_add("fingerprint", r"SELECT doc_id, regexp_replace(lower(text), '[^\p{Latin}0-9]', '', 'g') AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.fingerprint("text").alias("fingerprint"))


@_add("replace_runs", "SELECT doc_id, regexp_replace(replace(text, '.', ''), 'e{2,}', 'e', 'g') AS text FROM documents")
def replace_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.replace_all(fn.replace_all("text", ".", "", strict=False), "ee", "e", strict=False).alias("text"))


@_add("replace_set", "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '#') THEN o_orderpriority ELSE regexp_replace(o_orderpriority, '[0-9]', '#', 'g') END AS priority FROM orders")
def replace_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.replace_all("o_orderpriority", "[0-9]", "#").alias("priority"))


_CAPITAL = "upper(w[1]) || w[2:]"


@_add(
    "start_case",
    f"SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || '-' || p_type), ' '), lambda x: array_to_string(list_transform(string_split(x, '-'), lambda w: {_CAPITAL}), '-')), ' ') AS name FROM part",
)
def start_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.start_case(F.concat_ws("-", "p_name", "p_type")).alias("name"))


@_add(
    "title_case",
    f"SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' of the ' || p_type), ' '), lambda w, i: CASE WHEN i = 1 OR w NOT IN {MINOR_WORDS} THEN {_CAPITAL} ELSE w END), ' ') AS name FROM part",
)
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.title_case(F.concat_ws(" of the ", "p_name", "p_type")).alias("name"))


@_add("string_split_item", "SELECT p_partkey, coalesce(string_split(p_name, ' ')[2], '') AS second, coalesce(string_split(p_name, ' ')[1], '') AS first FROM part")
def string_split_item(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.string_split_item("p_name", " ", 1).alias("second"), fn.string_split_item("p_name", " ", -3).alias("first"))


@_add("string_split", "SELECT p_partkey, trim(unnest(string_split(p_name, 'e')), ' ') AS value, (generate_subscripts(string_split(p_name, 'e'), 1) - 1)::INT AS ordinal FROM part")
def string_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.inline(fn.split_rows("p_name", "e")))


_SHARE = "((p_retailprice - 900) / (2000 - 900))"
_HEX = " || ".join(f"printf('%02X', (((trunc({a} + ({b} - {a}) * {_SHARE}))::BIGINT % 256) + 256) % 256)" for a, b in ((84, 27), (27, 140), (140, 27)))


@_add("gradient_hex", f"SELECT p_partkey, '#' || {_HEX} AS colour FROM part")
def gradient_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.gradient_hex("p_retailprice", 900.0, 2000.0, "#541b8c", "#1b8c1b").alias("colour"))


_CODE = "printf('%06x', (p_partkey * 7919) % 16777216)"


@_add(
    "hexcode_to_rgb",
    " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS rgb, (('0x' || substr({_CODE}, {k}, 2))::INT) AS value FROM part" for k, c in ((1, "r"), (3, "g"), (5, "b"))),
)
def hexcode_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")))
    return table(spark, d, "part").select("p_partkey", F.inline(fn.hexcode_to_rgb(code)))


_SHORT = "printf('%03x', (p_partkey * 37) % 4096)"


@_add("hexcode_short", " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS rgb, ('0x' || substr({_SHORT}, {k}, 1) || substr({_SHORT}, {k}, 1))::INT AS value FROM part WHERE p_partkey % 3 <> 0" for k, c in ((1, "r"), (2, "g"), (3, "b"))))
def hexcode_short(spark: SparkSession, d: str) -> DataFrame:
    """Codes of three digits, and codes of another length, which give no rows."""
    code = F.concat(F.when(F.col("p_partkey") % 3 == 0, "#1").otherwise("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 37) % 4096), 3, "0")))
    return table(spark, d, "part").select("p_partkey", F.inline(fn.hexcode_to_rgb(code)))


_PAIR = "regexp_full_match(rest[1:2], '[A-Z][A-Z]')"


@_add(
    "extract_windows",
    f"""WITH RECURSIVE w AS (SELECT DISTINCT o_orderpriority AS s, o_orderpriority AS rest, '' AS kept FROM orders
    UNION ALL SELECT s, CASE WHEN {_PAIR} THEN rest[2:] ELSE rest[3:] END, CASE WHEN {_PAIR} THEN kept || rest[1:1] ELSE kept END FROM w WHERE rtrim(rest, ' ') <> '')
    SELECT o_orderkey, kept || rest AS capitals FROM orders JOIN w ON s = o_orderpriority WHERE rtrim(rest, ' ') = ''""",
)
def extract_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two characters."""
    return table(spark, d, "orders").select("o_orderkey", fn.extract_pattern("o_orderpriority", "[A-Z][A-Z]", 2).alias("capitals"))


@_add("replace_settled", "SELECT doc_id, md5(regexp_replace(text, 'e+n', 'n', 'g')) AS text_md5 FROM documents")
def replace_settled(spark: SparkSession, d: str) -> DataFrame:
    """Until nothing changes."""
    return table(spark, d, "documents").select("doc_id", F.md5(fn.replace_all("text", "en", "n", strict=False)).alias("text_md5"))


_NESTED = "'{' || chr(10) || chr(9) || '\"a\": [' || chr(10) || chr(9) || chr(9) || event_id || ',' || chr(10) || chr(9) || chr(9) || '{' || chr(10) || chr(9) || chr(9) || chr(9) || '\"b\": \"' || event_type || '\"' || chr(10) || chr(9) || chr(9) || '}' || chr(10) || chr(9) || '],'"


@_add("json_nested", f"SELECT event_id, {_NESTED} || chr(10) || chr(9) || '\"p\": ' || replace(replace(props, '{{', '{{' || chr(10) || chr(9) || chr(9)), '}}', chr(10) || chr(9) || '}}') || chr(10) || '}}' AS props FROM events")
def json_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = F.concat(F.lit('{"a" : [ '), F.col("event_id").cast("string"), F.lit(',\n{"b":"'), "event_type", F.lit('"}],\t"p":'), "props", F.lit(" }"))
    return table(spark, d, "events").select("event_id", fn.json_formatter(nested).alias("props"))


@_add("json_formatter", r"SELECT event_id, replace(replace(props, '{', '{' || chr(10) || chr(9)), '}', chr(10) || '}') AS props FROM events")
def json_formatter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.json_formatter("props").alias("props"))


# distances and predicates, on each part name and the next of its brand


_PAIRS_SQL = "(SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Null for the last part of a brand."""
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b"))


def _measured(distance: str) -> str:
    return f"CASE WHEN a = b THEN 0 WHEN b IS NULL THEN nullif(length(a), 0) ELSE {distance}(a, b) END"


# one row of the table of distances in each step, for each distinct pair
_OSA_ROWS = f"""WITH RECURSIVE pairs AS {_PAIRS_SQL}, steps AS (
  SELECT DISTINCT a, b, 0 AS i, []::INT[] AS before, range(0, length(b) + 1)::INT[] AS last FROM pairs WHERE b IS NOT NULL
  UNION ALL
  SELECT a, b, i + 1, last, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::INT]), lambda acc, x: list_append(acc, least(
    acc[len(acc)] + 1, last[x[1] + 1] + 1, last[x[1]] + CASE WHEN a[i + 1] = b[x[1]] THEN 0 ELSE 1 END,
    CASE WHEN i >= 1 AND x[1] > 1 AND a[i + 1] = b[x[1] - 1] AND a[i] = b[x[1]] THEN before[x[1] - 1] + 1 ELSE 1000000 END)), [(i + 1)::INT])
  FROM steps WHERE i < length(a)),
osa AS (SELECT p_partkey, pairs.a, pairs.b, CASE WHEN pairs.b IS NULL THEN nullif(length(pairs.a), 0) ELSE last[length(pairs.b) + 1] END AS distance
  FROM pairs LEFT JOIN steps ON steps.a = pairs.a AND steps.b = pairs.b AND i = length(steps.a))"""


_JARO = "CASE WHEN a = b THEN 1.0 WHEN b IS NULL THEN 0.0 ELSE jaro_similarity(a, b) END"
_PREFIX = "CASE " + " ".join(f"WHEN length(a) >= {k} AND length(b) >= {k} AND left(a, {k}) = left(b, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
_DECIMAL = "::DECIMAL(9,8)"
_WINKLER = f"(CASE WHEN a = b THEN 1.0 WHEN b IS NULL THEN 0.0 ELSE ({_JARO}){_DECIMAL}::DOUBLE + 0.1 * ({_PREFIX}) * (1 - ({_JARO}){_DECIMAL}::DOUBLE) END)"

_DISTANCES: dict[str, tuple[Callable[..., Column], str | None]] = {
    "levenshtein_distance": (fn.levenshtein_distance, _measured("levenshtein") + "::INT"),
    "osa_distance": (fn.osa_distance, None),
    "damerau_levenshtein_distance": (fn.damerau_levenshtein_distance, _measured("damerau_levenshtein") + "::INT"),
    "jaro_similarity": (fn.jaro_similarity, f"({_JARO}){_DECIMAL}"),
    "jaro_winkler_similarity": (fn.jaro_winkler_similarity, f"{_WINKLER}{_DECIMAL}"),
}
for _name, (_function, _sql) in _DISTANCES.items():

    def _distance(spark: SparkSession, d: str, function=_function) -> DataFrame:
        return _pairs(spark, d).select("p_partkey", function("a", "b").cast("double").alias("distance"))

    _add(_name, f"SELECT p_partkey, ({_sql})::DOUBLE AS distance FROM {_PAIRS_SQL}" if _sql else f"{_OSA_ROWS} SELECT p_partkey, distance::DOUBLE AS distance FROM osa")(_distance)

_LONGER = "greatest(length(a), length(b))"
_TESTS: dict[str, tuple[str, str]] = {
    "exact": ("1", "a = b"),
    "levenshtein": ("4", "CASE WHEN b IS NULL THEN length(a) <= 4 ELSE levenshtein(a, b) <= 4 END"),
    "levenshtein_low": ("3", "CASE WHEN b IS NULL THEN length(a) <= 3 ELSE levenshtein(a, b) <= 3 END"),
    "levenshtein_normalised": ("0.5", f"levenshtein(a, b) <= 0.5 * {_LONGER}"),
    "levenshtein_low_normalised": ("0.5", f"CASE WHEN b IS NULL THEN false ELSE levenshtein(a, b) <= trunc(0.5 * {_LONGER}) END"),
    "osa": ("4", "distance <= 4"),
    "osa_low": ("3", "distance <= 3"),
    "osa_normalised": ("0.5", f"b IS NOT NULL AND distance <= 0.5 * {_LONGER}"),
    "osa_low_normalised": ("0.5", f"b IS NOT NULL AND distance <= trunc(0.5 * {_LONGER})"),
    "damerau_levenshtein": ("4", "CASE WHEN b IS NULL THEN length(a) <= 4 ELSE damerau_levenshtein(a, b) <= 4 END"),
    "damerau_levenshtein_normalised": ("0.5", f"damerau_levenshtein(a, b) <= 0.5 * {_LONGER}"),
    "jaro": ("0.6", f"({_JARO}){_DECIMAL} >= 0.6"),
    "jaro_winkler": ("0.65", f"{_WINKLER}{_DECIMAL} >= 0.65"),
}
for _name, (_threshold, _sql) in _TESTS.items():

    def _predicate(spark: SparkSession, d: str, name=_name, threshold=_threshold) -> DataFrame:
        return _pairs(spark, d).select("p_partkey", PREDICATES[name]("a", "b", threshold).alias("matches"))

    _from = f"{_OSA_ROWS} SELECT p_partkey, coalesce({_sql}, false) AS matches FROM osa" if _name.startswith("osa") else f"SELECT p_partkey, coalesce({_sql}, false) AS matches FROM {_PAIRS_SQL}"
    _add(f"matching_{_name}", _from)(_predicate)


# matching and mashing


_NUMBERED = "n AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pid, p_partkey AS id, p_brand, p_name, p_size FROM part), k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS partition FROM (SELECT DISTINCT p_brand FROM part))"


def _matched(rule: str) -> str:
    return f"WITH {_NUMBERED}, m AS (SELECT k.partition, l.pid AS l_pid, r.pid AS r_pid, l.id AS l_id, r.id AS r_id FROM n l JOIN n r ON l.p_brand = r.p_brand AND l.pid < r.pid AND {rule} JOIN k ON k.p_brand = l.p_brand)"


_MATCHED = _matched("levenshtein(l.p_name, r.p_name) <= 2")


def _match_parts(spark: SparkSession, d: str, **how) -> DataFrame:
    return match(table(spark, d, "part"), "p_partkey", "p_brand", "p_retailprice DESC", "p_name,levenshtein_low,2", **how)


@_add("match", f"{_MATCHED} SELECT * FROM m")
def match_parts(spark: SparkSession, d: str) -> DataFrame:
    return _match_parts(spark, d)


@_add("match_sizes", f"{_matched('l.p_size = r.p_size AND levenshtein(l.p_name, r.p_name) <= 5')} SELECT * FROM m")
def match_sizes(spark: SparkSession, d: str) -> DataFrame:
    """An equality, which joins, beside a distance."""
    return match(table(spark, d, "part"), "p_partkey", "p_brand", "p_retailprice DESC", "p_size,exact,1;p_name,levenshtein_low,5")


_SPELLINGS = ("Éa", "Ea", "Ea ", "Ob")


@_add(
    "match_spellings",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pid, c_custkey AS id, lpad(c_nationkey::VARCHAR, 2, '0') || CASE c_custkey % 4 WHEN 3 THEN 'Ob' ELSE 'Ea' END AS block, c_mktsegment FROM customer),
    k AS (SELECT block, row_number() OVER (ORDER BY block) AS partition FROM (SELECT DISTINCT block FROM n))
    SELECT k.partition, l.pid AS l_pid, r.pid AS r_pid, l.id AS l_id, r.id AS r_id FROM n l JOIN n r ON l.block = r.block AND l.pid < r.pid AND l.c_mktsegment = r.c_mktsegment JOIN k ON k.block = l.block""",
)
def match_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Blocking keys that differ in accents and trailing blanks only."""
    spelling = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return match(table(spark, d, "customer"), "c_custkey", F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), spelling), "c_acctbal ASC", "c_mktsegment,exact,1")


_NEAR = "jaro_similarity(l.c_name, r.c_name)"
_ALIKE = "CASE " + " ".join(f"WHEN left(l.c_name, {k}) = left(r.c_name, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"


@_add(
    "match_customers",
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pid, c_custkey AS id, c_nationkey::VARCHAR || c_mktsegment AS block, c_name FROM customer),
    k AS (SELECT block, row_number() OVER (ORDER BY block) AS partition FROM (SELECT DISTINCT block FROM n))
    SELECT k.partition, l.pid AS l_pid, r.pid AS r_pid, l.id AS l_id, r.id AS r_id FROM n l JOIN n r ON l.block = r.block AND l.pid < r.pid JOIN k ON k.block = l.block
    WHERE ({_NEAR}{_DECIMAL}::DOUBLE + 0.1 * ({_ALIKE}) * (1 - {_NEAR}{_DECIMAL}::DOUBLE)){_DECIMAL} >= 0.97""",
)
def match_customers(spark: SparkSession, d: str) -> DataFrame:
    """A rule that runs in Python, and one that allows nulls."""
    return match(table(spark, d, "customer"), "c_custkey", "concat(c_nationkey, c_mktsegment)", "c_acctbal ASC", "c_name,jaro_winkler,0.97;c_mktsegment,exact,1,a")


def _rounds(n: int) -> str:
    """Rounds of mashing, unrolled."""
    out = ["r0 AS (SELECT *, row_number() OVER (ORDER BY l_pid, l_id, r_id) AS p FROM m)"]
    for k in range(n):
        out.append(
            f"b{k} AS (SELECT y.p, min_by({{'l_id': x.l_id, 'l_pid': x.l_pid}}, x.p) AS new FROM r{k} y JOIN r{k} x ON x.p < y.p AND x.l_id <> y.l_id AND (x.r_id = y.l_id OR x.r_id = y.r_id) GROUP BY y.p), "
            f"r{k + 1} AS (SELECT partition, coalesce(new.l_pid, l_pid) AS l_pid, r_pid, coalesce(new.l_id, l_id) AS l_id, r_id, y.p FROM r{k} y LEFT JOIN b{k} ON b{k}.p = y.p)"
        )
    return ", ".join(out) + f" SELECT partition, l_pid, r_pid, l_id, r_id FROM (SELECT *, row_number() OVER (PARTITION BY l_id, r_id ORDER BY p) AS first FROM r{n}) WHERE first = 1"


@_add("match_and_mash", f"{_MATCHED}, {_rounds(8)}")
def match_and_mash(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts, mashed without being formed."""
    return _match_parts(spark, d, mash=True)


def _rounds_from(n: int) -> str:
    """The same where only the rows of a source rewrite others."""
    return _rounds(n).replace("SELECT *, row_number() OVER (ORDER BY l_pid, l_id, r_id) AS p FROM m", "SELECT *, row_number() OVER (ORDER BY l_pid, l_id, r_id) AS p, l_id % 2 AS source FROM m").replace("x ON x.p < y.p", "x ON x.source = 1 AND x.p < y.p").replace("r_id, y.p FROM", "r_id, y.p, y.source FROM")


@_add("mash_from_source", f"{_MATCHED}, {_rounds_from(8)}")
def mash_from_source(spark: SparkSession, d: str) -> DataFrame:
    """The same where pairs of odd masters are the source and the others the target."""
    return _match_parts(spark, d, mash=True, source=lambda l_id: l_id % 2 == 1)


# structure, shape, reports


_WANTED = [Field("p_partkey", "int"), Field("p_name", "varchar", 9), Field("p_type", "varchar", 40, nullable=False), Field("p_brand", "varchar", 12), Field("p_retailprice", "decimal", 6, 1), Field("p_comment", "varchar", 4)]


@_add(
    "structure_compliance",
    """WITH s AS (SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, nullif(p_type, 'PROMO') AS p_type, p_size::VARCHAR AS p_size, printf('%.2f', p_retailprice) AS p_retailprice FROM part)
    SELECT *, 'Column error: [p_type] (4) should be in position 3, [p_brand] (3) should be in position 4, [p_retailprice] (6) should be in position 5, [p_comment] is missing from position 6, [p_size] (5) is spurious. '
    || CASE WHEN length(p_name) > 9 THEN 'Truncation error: [p_name] would be truncated when converted to varchar(9). ' ELSE '' END
    || 'Truncation error: [p_retailprice] would be truncated when converted to decimal(6, 1). '
    || CASE WHEN p_type IS NULL THEN 'Nullability error: [p_type] does not contain data. ' ELSE '' END
    || CASE WHEN count(*) OVER (PARTITION BY p_name, p_brand) > 1 THEN 'Uniqueness error: ([p_name], [p_brand]) contains duplicates. ' ELSE '' END AS __error__ FROM s""",
)
def compliance(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "part").select(
        F.col("p_partkey").cast("string"), "p_name", "p_brand", F.nullif("p_type", F.lit("PROMO")).alias("p_type"), F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice").alias("p_retailprice")
    )
    unique = [Field(f.name, f.datatype, f.length, f.scale, f.nullable, 1 if f.name in ("p_name", "p_brand") else None) for f in _WANTED]
    return structure_compliance(text, unique)


@_add(
    "string_table_split",
    """SELECT c_custkey, 1 AS line, 'name' AS Field, c_name AS Value FROM customer UNION ALL SELECT c_custkey, 2, 'segment', c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, 3, 'nation', c_nationkey::VARCHAR FROM customer""",
)
def table_split(spark: SparkSession, d: str) -> DataFrame:
    """A text of each customer, with a header, as lines of a table."""
    spelled = F.concat(F.lit("Field,Value;name,"), "c_name", F.lit(";segment,"), "c_mktsegment", F.lit(";nation,"), F.col("c_nationkey").cast("string"))
    return string_tables_split(table(spark, d, "customer").select("c_custkey", spelled.alias("text")), "text", ["Field", "Value"])


@_add("string_table_split_wide", "SELECT p_partkey, 1 AS line, p_name AS Column1, p_type AS Column2 FROM part UNION ALL SELECT p_partkey, 2, ';' || p_brand, '|' FROM part")
def table_split_wide(spark: SparkSession, d: str) -> DataFrame:
    """Separators of several characters, no header."""
    spelled = F.concat("p_name", F.lit("||"), "p_type", F.lit(";;;"), "p_brand", F.lit("|||"))
    return string_tables_split(table(spark, d, "part").select("p_partkey", spelled.alias("text")), "text", ["Column1", "Column2"], "||", ";;", header=False)


_NATIONS = ", ".join(f"max(CASE WHEN n_nationkey = {k} THEN {{}} END) AS \"{k}\"" for k in range(25))


@_add("transpose", f"SELECT 'n_name' AS n_nationkey, {_NATIONS.format(*['n_name'] * 25)} FROM nation UNION ALL SELECT 'n_regionkey', {_NATIONS.format(*['n_regionkey::VARCHAR'] * 25)} FROM nation")
def transposed(spark: SparkSession, d: str) -> DataFrame:
    return transpose(table(spark, d, "nation"))


_STYLE = "font-size:.9em;font-family:Verdana,Sans-Serif;border:3px solid"


def _td(style: str, value: str) -> str:
    return f"chr(9) || chr(9) || '<td style=\"' || {style} || '\">' || {value} || '</td>' || chr(10)"


_PLAIN_ROW = " || ".join(_td(f"'border:2px solid;text-align:{a}'", v) for a, v in (("right", "n_nationkey"), ("left", "n_name"), ("right", "n_regionkey")))
_PLAIN_HEAD = " || ".join(f"chr(9) || chr(9) || '<th style=\"border:2px solid;text-align:center\">{c}</th>' || chr(10)" for c in ("n_nationkey", "n_name", "n_regionkey"))


@_add(
    "select_to_html",
    f"SELECT '<table style=\"{_STYLE};border-collapse:collapse\">' || chr(10) || chr(9) || '<tr>' || chr(10) || {_PLAIN_HEAD} || chr(9) || '</tr>' || chr(10) || string_agg(chr(9) || '<tr>' || chr(10) || {_PLAIN_ROW} || chr(9) || '</tr>' || chr(10), '' ORDER BY n_nationkey) || '</table>' AS html FROM nation",
)
def html(spark: SparkSession, d: str) -> DataFrame:
    return select_to_html(table(spark, d, "nation"), "n_nationkey ASC")


_LIGHT = " || ".join(f"printf('%02X', trunc(255 + ({c} - 255.0) * (n_regionkey / 4.0))::BIGINT)" for c in (0x72, 0xAB, 0xE3))
_B = "'border:2px solid #000000;background-color:"
_COLOUR_ROW = " || ".join(
    [
        _td(f"{_B}#541b8c;color:#ffffff;text-align:center'", "n_nationkey"),
        _td(f"{_B}' || CASE WHEN n_nationkey % 2 = 0 THEN '#ffffff' ELSE '#cfcfcf' END || ';color:#000000;text-align:center'", "n_name"),
        _td(f"{_B}#' || {_LIGHT} || ';color:#000000;text-align:right'", "n_regionkey"),
    ]
)
_COLOUR_HEAD = " || ".join(f"chr(9) || chr(9) || '<th style=\"background-color:#181848;border:2px solid #000000;text-align:center\">{c}</th>' || chr(10)" for c in ("n_nationkey", "n_name", "n_regionkey"))
_TOTAL = " || ".join(
    [
        _td(f"{_B}#541b8c;color:#ffffff;text-align:center;font-style:italic'", "'Total'"),
        _td(f"{_B}#000000;color:#000000;text-align:center'", "''"),
        _td(f"{_B}#72abe3;color:#000000;text-align:right;font-style:italic'", "sum(n_regionkey)::VARCHAR"),
    ]
)


@_add(
    "select_to_html_colour",
    f"SELECT '<table style=\"{_STYLE} #000000;border-collapse:collapse\">' || chr(10) || chr(9) || '<tr style=\"color:#ffffff\">' || chr(10) || {_COLOUR_HEAD} || chr(9) || '</tr>' || chr(10) || string_agg(chr(9) || '<tr>' || chr(10) || {_COLOUR_ROW} || chr(9) || '</tr>' || chr(10), '' ORDER BY n_nationkey) || chr(9) || '<tr>' || chr(10) || {_TOTAL} || chr(9) || '</tr>' || chr(10) || '</table>' AS html FROM nation",
)
def html_colour(spark: SparkSession, d: str) -> DataFrame:
    return select_to_html_colour(table(spark, d, "nation"), "n_nationkey ASC", sum=True)


_LOG = """WITH e AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), min(ts) OVER (PARTITION BY user_id)) AS s0 FROM events),
x AS (SELECT user_id::VARCHAR AS session_id, nullif(user_id % 5, 2)::VARCHAR AS plan_id, nullif(user_id % 10, 3)::VARCHAR AS batch_id, coalesce(event_type, '') AS process,
  row_number() OVER (PARTITION BY user_id, t0 ORDER BY s0, event_id) AS process_instance, event_id AS instance_id, t0 AS task_start, max(ts) OVER (PARTITION BY user_id, t0) AS task_end, s0 AS instance_start, ts AS instance_end FROM e),
y AS (SELECT *, ((epoch_us(task_end) - epoch_us(task_start)) // 1000)::BIGINT AS task_duration, ((epoch_us(instance_end) - epoch_us(instance_start)) // 1000)::BIGINT AS instance_duration FROM x)
SELECT *, """ + ", ".join(
    f"{f}({of}) OVER (PARTITION BY session_id, {key})::BIGINT AS {by}_{f}" if f != "avg" else f"trunc(sum({of}) OVER (PARTITION BY session_id, {key}) / count({of}) OVER (PARTITION BY session_id, {key}))::BIGINT AS {by}_avg"
    for by, key, of in (("plan", "plan_id", "task_duration"), ("batch", "batch_id", "task_duration"), ("process", "process", "instance_duration"))
    for f in ("min", "avg", "max")
) + " FROM y"


@_add("timer_report", _LOG)
def timer(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user as a task, each event ending an instance; some have no plan or batch."""
    own = Window.partitionBy("user_id")
    first = F.min("ts").over(own)
    log = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("process"), F.col("event_id").alias("instance_id"), first.alias("task_start"),
        F.coalesce(F.lag("ts").over(own.orderBy("ts", "event_id")), first).alias("instance_start"), F.col("ts").alias("instance_end"),
        F.nullif(F.col("user_id") % 10, F.lit(3)).cast("string").alias("batch_id"), F.nullif(F.col("user_id") % 5, F.lit(2)).cast("string").alias("plan_id"),
    )
    return report(log)


@_add(
    "print_parts",
    """WITH RECURSIVE s AS (SELECT doc_id, -1 AS part, replace(text, chr(13), chr(10)) AS rest, NULL::VARCHAR AS printed FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, part + 1, CASE WHEN p = 0 THEN rest[4001:] ELSE rest[p + 1:] END, CASE WHEN p = 0 THEN rest[1:4000] ELSE rest[1:p - 1] END
      FROM (SELECT *, CASE WHEN contains(rest[1:4000], chr(10)) THEN length(rest[1:4000]) - position(chr(10) IN reverse(rest[1:4000])) + 1 ELSE 0 END AS p FROM s) WHERE rtrim(rest, ' ') <> '')
    SELECT doc_id, part::INT AS part, md5(printed) AS printed_md5 FROM s WHERE part >= 0""",
)
def printed(spark: SparkSession, d: str) -> DataFrame:
    """Long texts in the parts that are printed one after another."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(printed_parts("text")).alias("part", "printed")).select("doc_id", "part", F.md5("printed").alias("printed_md5"))


_ROWS = "string_agg(chr(9) || '(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')', ',' || chr(10) ORDER BY n_nationkey)"


@_add(
    "db_creator",
    f"""SELECT kind, place, name, text FROM (VALUES
      ('SC', 1, NULL, 'CREATE SCHEMA IF NOT EXISTS `made`'),
      ('FN', 2, 'twice', 'CREATE OR REPLACE FUNCTION `made`.`twice`(n INT) RETURNS INT RETURN n * 2'),
      ('U', 3, 'nations', 'CREATE TABLE IF NOT EXISTS `made`.`nations` (' || chr(10) || '  n_nationkey INT COMMENT ''the key'',' || chr(10) || '  n_name STRING,' || chr(10) || '  n_regionkey INT)' || chr(10) || 'USING parquet' || chr(10) || 'PARTITIONED BY (n_regionkey)' || chr(10) || 'COMMENT ''by region'''),
      ('FN', 4, 'counted', 'CREATE OR REPLACE FUNCTION `made`.`counted`(least INT) RETURNS BIGINT RETURN (SELECT count(*) FROM made.nations WHERE n_nationkey >= least)'),
      ('V', 6, 'first', 'CREATE OR REPLACE VIEW `made`.`first` AS SELECT n_name FROM made.nations WHERE n_nationkey = 0'),
      ('V', 7, 'again', 'CREATE OR REPLACE VIEW `made`.`again` AS SELECT n_name, made.counted(1) AS others FROM made.first')) AS t(kind, place, name, text)
    UNION ALL SELECT 'DT', 5, 'nations', 'INSERT INTO `made`.`nations` (`n_nationkey`, `n_name`, `n_regionkey`)' || chr(10) || 'VALUES' || chr(10) || {_ROWS} FROM nation""",
)
def created(spark: SparkSession, d: str) -> DataFrame:
    """The definitions of a schema that is made for this and dropped again."""
    made = f"made_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {made}")
    try:
        spark.sql(f"CREATE TABLE {made}.nations (n_nationkey INT COMMENT 'the key', n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey) COMMENT 'by region'")
        table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.insertInto(f"{made}.nations")
        spark.sql(f"CREATE VIEW {made}.first AS SELECT n_name FROM {made}.nations WHERE n_nationkey = 0")
        spark.sql(f"CREATE FUNCTION {made}.twice(n INT) RETURNS INT RETURN n * 2")
        spark.sql(f"CREATE FUNCTION {made}.counted(least INT) RETURNS BIGINT RETURN (SELECT count(*) FROM {made}.nations WHERE n_nationkey >= least)")
        spark.sql(f"CREATE VIEW {made}.again AS SELECT n_name, {made}.counted(1) AS others FROM {made}.first")
        found = definitions(spark, [made], data=True)
    finally:
        spark.sql(f"DROP SCHEMA {made} CASCADE")
    rows = [(x.kind, k, x.name, x.text.replace(made, "made")) for k, x in enumerate(found, 1)]
    return spark.createDataFrame(rows, "kind string, place int, name string, text string")
