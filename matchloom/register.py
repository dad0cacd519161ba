"""SQL names for the functions, as temporary functions of the session.

Native ones are SQL functions, with default arguments where there are any; those that need Python are wrapped so that the rules for
nulls are the same as in ``matchloom.functions``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

from .functions import distance, strings
from .functions.norm import ACCENTED_LETTERS, COLLATION, PLAIN_LETTERS
from .operators.timer import print_parts

_EQUAL = f"(a COLLATE {COLLATION} = b COLLATE {COLLATION})"
_FOLD = f"rtrim(translate({{}}, '{ACCENTED_LETTERS}', '{PLAIN_LETTERS}'))"
_A, _B = _FOLD.format("a"), _FOLD.format("b")
_SIZE_A, _SIZE_B = "length(rtrim(a))", "length(rtrim(b))"
_LONGER = f"if({_SIZE_A} < {_SIZE_B}, {_SIZE_B}, {_SIZE_A})"


def _measure(call: str) -> str:
    return f"CASE WHEN {_EQUAL} THEN 0 WHEN a IS NULL AND b IS NULL THEN {distance.NULLS} WHEN a IS NULL THEN {_SIZE_B} WHEN b IS NULL THEN nullif({_SIZE_A}, 0) ELSE {call} END"


def _normalised(measure: str) -> str:
    return f"CASE WHEN threshold = 0 THEN coalesce({_EQUAL}, false) WHEN threshold < 0 THEN false WHEN threshold >= 1 THEN true ELSE coalesce({measure}(a, b) <= threshold * {_LONGER}, false) END"


def _low(measure: str, threshold: str = "threshold") -> str:
    """The rule of the low family; the threshold may be null."""
    return (
        f"CASE WHEN {threshold} < 0 THEN false WHEN a IS NULL AND b IS NULL THEN false WHEN {_EQUAL} THEN true WHEN {threshold} = 0 THEN false "
        f"WHEN a IS NULL OR {_SIZE_A} = 0 THEN NOT coalesce({_SIZE_B} > {threshold}, false) WHEN b IS NULL OR {_SIZE_B} = 0 THEN NOT coalesce({_SIZE_A} > {threshold}, false) "
        f"WHEN abs({_SIZE_A} - {_SIZE_B}) > {threshold} THEN false ELSE coalesce({measure}(a, b) <= {threshold}, false) END"
    )


_CUT = f"CAST(threshold * {_LONGER} AS INT)"
_TWO = "a STRING, b STRING"


def _hexes(code: str, at: int) -> str:
    wide = f"if(length({code}) = 4, regexp_replace(substring({code}, 2, 3), '(.)', '$1$1'), substring({code}, 2, 6))"
    return f"CAST(conv(substring({wide}, {at}, 2), 16, 10) AS DOUBLE)"


def _sound(value: str) -> str:
    return f"CASE WHEN hexcode IS NULL OR NOT length(hexcode) IN (4, 7) THEN NULL WHEN substring(hexcode, 2) RLIKE '^[0-9A-Fa-f]+$' THEN {value} ELSE CAST(raise_error(concat('not a colour: ', hexcode)) AS DOUBLE) END"


def _channel(at: int) -> str:
    a, b = _hexes("hexmin", at), _hexes("hexmax", at)
    return f"lpad(hex(pmod(CAST({a} + ({b} - {a}) * try_divide(target - lower_, upper_ - lower_) AS BIGINT), 256)), 2, '0')"


def _title() -> str:
    """``title_case`` of ``string``."""
    minor = ", ".join(f"'{w}'" for w in strings.MINOR_WORDS)
    raised = "concat(if(substr(word, 1, 1) = 'ß', 'ß', upper(substr(word, 1, 1))), substr(word, 2))"
    words = f"transform(split(part, r'(?<=[{strings.TITLE_BETWEEN}])', -1), (word, k) -> if(rtrim(word) IN ({minor}) AND k <> length(regexp_extract(part, r'^[{strings.TITLE_BETWEEN}]*', 0)), word, {raised}))"
    return f"CASE WHEN string <> '' THEN array_join(transform(split(lower(string), r'(?<=[{strings.TITLE_ENDS}])', -1), part -> array_join({words}, '')), '') END"


def _json() -> str:
    """``json_formatter`` of ``string``: a fold over tokens in folds over ``FOLD`` of them."""
    state = "named_struct('out', '', 'depth', {}, 'before', {})".format
    line = "concat(chr(10), repeat(chr(9), {}), t)".format
    outer = "greatest(s.depth - 1, 0)"
    piece = f"CASE WHEN t = ':' THEN ': ' WHEN t IN ('}}', ']') THEN {line(outer)} WHEN t = ',' OR s.before = ':' THEN t ELSE {line('s.depth')} END"
    depth = f"CASE WHEN t IN ('{{', '[') THEN s.depth + 1 WHEN t IN ('}}', ']') THEN {outer} ELSE s.depth END"
    inner = f"aggregate(slice(tokens, k * {strings.FOLD} + 1, {strings.FOLD}), {state('p.last.depth', 'p.last.before')}, (s, t) -> named_struct('out', concat(s.out, {piece}), 'depth', {depth}, 'before', t))"
    start = f"named_struct('parts', CAST(array() AS ARRAY<STRING>), 'last', {state('0', chr(39) * 2)})"
    parts = "concat(p.parts, array(p.last.out))"
    whole = f"aggregate(sequence(0, CAST(floor((size(tokens) - 1) / {strings.FOLD}) AS INT)), {start}, (p, k) -> named_struct('parts', {parts}, 'last', {inner}), p -> array_join({parts}, ''))"
    tokens = f"regexp_extract_all(translate(string, concat(chr(10), chr(9)), ''), r'{strings.JSON_TOKEN}', 0)"
    return f"get(transform(array({tokens}), tokens -> CASE WHEN size(tokens) = 0 THEN '' WHEN size(tokens) > 0 THEN regexp_replace({whole}, r'\\A\\n', '') END), 0)"


#: name -> (parameters, type or RETURNS TABLE, body)
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "fn_age": ("start_date DATE, end_date DATE DEFAULT NULL", "INT", "CAST((CAST(date_format(coalesce(end_date, current_date()), 'yyyyMMdd') AS INT) - CAST(date_format(start_date, 'yyyyMMdd') AS INT)) / 10000 AS INT)"),
    "fn_extract_param": ("string STRING, key STRING, separator STRING DEFAULT ';', include_key BOOLEAN DEFAULT false", "STRING", "matchloom_extract_param(string, key, separator, include_key)"),
    "fn_extract_pattern": ("string STRING, pattern STRING DEFAULT '[A..Z,0-9]', pattern_length INT DEFAULT 1", "STRING", "matchloom_extract_pattern(string, pattern, pattern_length)"),
    "fn_replace": ("old STRING, new STRING, strict BOOLEAN DEFAULT true, string STRING DEFAULT NULL", "STRING", "matchloom_replace(string, old, new, strict)"),
    "fn_fingerprint": ("string STRING", "STRING", r"regexp_replace(lower(string), r'[^\p{IsLatin}0-9]', '')"),
    "fn_start_case": (
        "string STRING",
        "STRING",
        r"array_join(transform(split(lower(string), r'(?<=[ \-\\&\t\n\r])'), x -> concat(if(substr(x, 1, 1) = 'ß', 'ß', upper(substr(x, 1, 1))), substr(x, 2))), '')",
    ),
    "fn_title_case": ("string STRING", "STRING", _title()),
    "fn_json_formatter": ("string STRING", "STRING", _json()),
    "fn_string_split_item": ("string STRING, separator STRING DEFAULT ',', item INT DEFAULT 0", "STRING", r"coalesce(get(split(string, concat(r'\Q', separator, r'\E'), -1), greatest(item, 0)), '')"),
    "fn_gradient_hex": ("target DOUBLE, lower_ DOUBLE, upper_ DOUBLE, hexmin STRING, hexmax STRING", "STRING", f"CASE WHEN lower_ = upper_ THEN hexmin ELSE concat('#', {_channel(1)}, {_channel(3)}, {_channel(5)}) END"),
    "fn_levenshtein_distance": (_TWO, "INT", _measure(f"levenshtein({_A}, {_B})")),
    "fn_osa_distance": (_TWO, "INT", _measure(f"matchloom_osa({_A}, {_B})")),
    "fn_damerau_levenshtein_distance": (_TWO, "INT", _measure(f"matchloom_damerau({_A}, {_B})")),
    "fn_jaro_similarity": (_TWO, "DECIMAL(9,8)", f"CAST(CASE WHEN {_EQUAL} THEN 1 ELSE coalesce(matchloom_jaro({_A}, {_B}), 0) END AS DECIMAL(9,8))"),
    "fn_jaro_winkler_similarity": (
        f"{_TWO}, scaling DOUBLE DEFAULT 0.1, max_prefix INT DEFAULT 4",
        "DECIMAL(9,8)",
        f"CAST(CASE WHEN {_EQUAL} THEN 1 ELSE CAST(fn_jaro_similarity(a, b) AS DOUBLE) + scaling * coalesce(array_max(transform(filter(sequence(0, max_prefix), k -> length({_A}) >= k AND left({_A}, k) = left({_B}, k)), k -> k)), 0) * (1 - CAST(fn_jaro_similarity(a, b) AS DOUBLE)) END AS DECIMAL(9,8))",
    ),
    "fn_matching_exact": (f"{_TWO}, threshold BOOLEAN DEFAULT true", "BOOLEAN", f"threshold AND coalesce({_EQUAL}, false)"),
    "fn_matching_levenshtein": (f"{_TWO}, threshold INT", "BOOLEAN", f"CASE WHEN threshold = 0 THEN coalesce({_EQUAL}, false) WHEN threshold < 0 THEN false ELSE coalesce(fn_levenshtein_distance(a, b) <= threshold, false) END"),
    "fn_matching_levenshtein_low": (f"{_TWO}, threshold INT", "BOOLEAN", _low("fn_levenshtein_distance")),
    "fn_matching_osa": (f"{_TWO}, threshold INT", "BOOLEAN", "coalesce(fn_osa_distance(a, b) <= threshold, false)"),
    "fn_matching_osa_low": (f"{_TWO}, threshold INT", "BOOLEAN", _low("fn_osa_distance")),
    "fn_matching_damerau_levenshtein": (f"{_TWO}, threshold INT", "BOOLEAN", "coalesce(fn_damerau_levenshtein_distance(a, b) <= threshold, false)"),
    **{f"fn_matching_{n}_normalised": (f"{_TWO}, threshold DECIMAL(6,5)", "BOOLEAN", _normalised(f"fn_{m}")) for n, m in (("levenshtein", "levenshtein_distance"), ("osa", "osa_distance"), ("damerau_levenshtein", "damerau_levenshtein_distance"))},
    **{f"fn_matching_{n}_low_normalised": (f"{_TWO}, threshold DECIMAL(6,5)", "BOOLEAN", _low(f"fn_{n}_distance", f"if(a IS NULL, NULL, {_CUT})")) for n in ("levenshtein", "osa")},
    "fn_matching_jaro": (f"{_TWO}, threshold DECIMAL(9,8)", "BOOLEAN", "coalesce(fn_jaro_similarity(a, b) >= threshold, false)"),
    "fn_matching_jaro_winkler": (f"{_TWO}, threshold DECIMAL(9,8)", "BOOLEAN", "coalesce(fn_jaro_winkler_similarity(a, b) >= threshold, false)"),
    "tf_string_split": ("string STRING, separator STRING DEFAULT ','", "TABLE (value STRING, ordinal INT)", r"SELECT trim(v), p FROM (SELECT posexplode(split(string, concat(r'\Q', separator, r'\E'), -1)) AS (p, v))"),
    "tf_hexcode_to_rgb": (
        "hexcode STRING",
        "TABLE (rgb STRING, value INT)",
        "SELECT c, CAST(v AS INT) FROM (SELECT stack(3, " + ", ".join(f"'{c}', {_sound(_hexes('hexcode', k))}" for c, k in (("r", 1), ("g", 3), ("b", 5))) + ") AS (c, v)) WHERE hexcode IS NULL OR length(hexcode) IN (4, 7)",
    ),
}


def _extract_param(string: pd.Series, key: pd.Series, separator: pd.Series, include_key: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or k is None else strings.extract_param_text(x, k, s or "", bool(i)) for x, k, s, i in zip(string, key, separator, include_key)], dtype=object)


def _extract_pattern(string: pd.Series, pattern: pd.Series, pattern_length: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or p is None else strings.extract_pattern_text(x, p, int(n)) for x, p, n in zip(string, pattern, pattern_length)], dtype=object)


def _replace(string: pd.Series, old: pd.Series, new: pd.Series, strict: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else strings.replace_text(x, a, b, bool(s)) for x, a, b, s in zip(string, old, new, strict)], dtype=object)


class StringTableSplit:
    """``p_string_table_split(string [, separator, row_separator, header, columns])``: the table that a text spells out.

    Columns are those of a constant text.  For the texts of a table, which are not known while the query is planned, ``columns`` lists their names, as a header would."""

    @staticmethod
    def analyze(string, separator=None, row_separator=None, header=None, columns=None):
        given = [a.value if a is not None and a.isConstantExpression else None for a in (separator, row_separator, header, columns)]
        between, below, header = given[0] or ",", given[1] or ";", given[2] is not False
        if given[3] is not None:
            names = given[3].split(between)
        elif string.isConstantExpression and string.value is not None:
            first = string.value.split(below)[0].split(between)
            names = first if header else [f"Column{k}" for k in range(1, len(first) + 1)]
        else:
            raise ValueError("columns must be listed for a text that is not constant")
        return AnalyzeResult(T.StructType([T.StructField(n, T.StringType()) for n in names]))

    def eval(self, string, separator=",", row_separator=";", header=True, columns=None):
        if string is None:
            return
        lines = [line.split(separator) for line in string.split(row_separator)]
        for line in lines[1 if header else 0 :]:
            if len(line) != len(lines[0]):
                raise ValueError(f"row with another number of items: {separator.join(line)}")
            yield tuple(line)


class Print:
    """``p_print(string [, most])``: a long text in the parts that are printed one after another."""

    def eval(self, string: str, most: int = 4000):
        for part in print_parts(string or "", most):
            yield (part,)


def register(spark: SparkSession) -> list[str]:
    """Registers all; returns their names."""
    for name, function, kind in (("osa", distance.osa_many, "int"), ("damerau", distance.damerau_many, "int"), ("jaro", distance.jaro_many, "double")):
        spark.udf.register(f"matchloom_{name}", distance.batched(function, kind))
    for name, function in (("extract_param", _extract_param), ("extract_pattern", _extract_pattern), ("replace", _replace)):  # their patterns may be columns
        spark.udf.register(f"matchloom_{name}", F.pandas_udf(function, "string"))
    spark.udtf.register("p_string_table_split", F.udtf(StringTableSplit))
    spark.udtf.register("p_print", F.udtf(Print, returnType="part string"))
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return ["p_string_table_split", "p_print", *SQL_FUNCTIONS]
