"""SQL names give what the column functions give."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from matchloom import functions as fn
from matchloom.register import register

NAMES = [None, "", "a", "ab", "ba", "abc", "é b", "Saturday", "Sunday", "kitty", "litter"]


@pytest.fixture(scope="module")
def pairs(spark):
    register(spark)
    return spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "a string, b string")


@pytest.mark.parametrize("name", ["levenshtein_distance", "osa_distance", "damerau_levenshtein_distance", "jaro_similarity", "jaro_winkler_similarity"])
def test_distances(pairs, name):
    own = getattr(fn, name)("a", "b")
    assert pairs.where(~F.expr(f"fn_{name}(a, b)").eqNullSafe(own)).collect() == []


@pytest.mark.parametrize("name", sorted(fn.PREDICATES))
def test_predicates(pairs, name):
    whole = not name.endswith("normalised") and not name.startswith("jaro")
    for t in ((0, 1) if name == "exact" else (-1, 0, 1, 3) if whole else ("-1", "0", "0.3", "0.6", "1")):
        shown = f"{bool(t)}" if name == "exact" else str(t)
        assert pairs.where(~F.expr(f"fn_matching_{name}(a, b, {shown})").eqNullSafe(fn.PREDICATES[name]("a", "b", t))).collect() == [], t


def test_others(spark, pairs):
    one = lambda sql: spark.sql(f"SELECT {sql}").first()[0]
    assert one("fn_age(date'1999-10-03', date'2024-01-06')") == 24 and one("fn_age(current_date())") == 0
    assert one("fn_fingerprint('F1inger-PR!INT')") == "f1ingerprint"
    assert one("fn_start_case('semi-EULERIAN gRaPh')") == "Semi-Eulerian Graph"
    assert one("fn_title_case('up AND away')") == "Up and Away" and one("fn_json_formatter('[1]')") == "[\n\t1\n]"
    assert one("fn_string_split_item('Link,Zelda,Ganondorf', item => 1)") == "Zelda" and one("fn_string_split_item('a;b', ';', 1)") == "b"
    assert one("fn_gradient_hex(1, 0, 2, '#000000', '#FFFFFF')") == "#7F7F7F"
    assert one("fn_jaro_winkler_similarity('virtuoso', 'virtuous')") == Decimal("0.95000000")
    rows = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert rows("SELECT * FROM tf_string_split('a, b')") == [("a", 0), ("b", 1)]
    assert rows("SELECT t.k, s.value FROM VALUES (1, 'x;y') AS t(k, v), LATERAL tf_string_split(t.v, ';') AS s") == [(1, "x"), (1, "y")]
    assert rows("SELECT * FROM tf_hexcode_to_rgb('#181848')") == [("r", 24), ("g", 24), ("b", 72)]
    assert rows("SELECT * FROM tf_hexcode_to_rgb('#12345')") == []


def test_patterns_under_sql_names(spark, pairs):
    one = lambda sql: spark.sql(f"SELECT {sql}").first()[0]
    assert one("fn_extract_param('server=<server>;database=<database>', 'database_')") == "<database>"
    assert one("fn_extract_pattern('Execute Order 66')") == "EO66" and one("fn_replace('  ', ' ', false, 'Three   spaces.')") == "Three spaces."
    rows = spark.createDataFrame([(x,) for x in (None, "", "  ", "a=1;b=2", "b=;a=é", "12ab34 ", "ABCd EF", "aab ab", "x.y.z", "New Old")], "s string")
    for key, separator, whole in (("[ab]=", ";", True), ("b=", ";", False), ("_=", "=", False), ("q", ";", False)):
        assert rows.where(~F.expr(f"fn_extract_param(s, '{key}', '{separator}', {whole})").eqNullSafe(fn.extract_param("s", key, separator, whole))).collect() == []
    for pattern, n in (("[A..Z,0-9]", 1), ("[A-Z][A-Z]", 2), ("[0-9][0-9]", 2), ("[^a]", 1), ("_b_", 3)):
        assert rows.where(~F.expr(f"fn_extract_pattern(s, '{pattern}', {n})").eqNullSafe(fn.extract_pattern("s", pattern, n))).collect() == []
    for old, new, strict in (("ab", "b", False), ("  ", " ", False), ("[^0-9]", "", False), ("Old", "New", True), ("a", "aa", False), (".", "$1", False), ("", "x", False), (None, "x", True), ("a", None, True)):
        shown = ", ".join("NULL" if x is None else f"'{x}'" for x in (old, new))
        assert rows.where(~F.expr(f"fn_replace({shown}, {strict}, s)").eqNullSafe(fn.replace_all("s", old, new, strict))).collect() == [], (old, new)


def test_bad_colours_are_errors(spark, pairs):
    for shown in ("SELECT * FROM tf_hexcode_to_rgb('#zzzzzz')", "SELECT * FROM tf_hexcode_to_rgb('#12g')"):
        with pytest.raises(Exception, match="not a colour"):
            spark.sql(shown).collect()
    assert {r[1] for r in spark.sql("SELECT * FROM tf_hexcode_to_rgb(CAST(NULL AS STRING))").collect()} == {None}


def test_procedures_as_table_functions(spark):
    register(spark)
    found = spark.sql("SELECT * FROM p_string_table_split('Boss,Location;Massive Moss Charger,Greenpath;Hornet,')")
    assert found.columns == ["Boss", "Location"] and sorted(map(tuple, found.collect())) == [("Hornet", ""), ("Massive Moss Charger", "Greenpath")]
    assert spark.sql("SELECT * FROM p_string_table_split('a|b', separator => '|', header => false)").collect() == [("a", "b")]
    spark.createDataFrame([(1, "x,y;1,2;3,4"), (2, None)], "k int, s string").createOrReplaceTempView("spelled")
    rows = spark.sql("SELECT k, t.* FROM spelled, LATERAL p_string_table_split(s, ',', ';', true, 'x,y') t").collect()
    assert sorted(map(tuple, rows)) == [(1, "1", "2"), (1, "3", "4")]
    assert [r.part for r in spark.sql("SELECT * FROM p_print('ab\\ncd', 4)").collect()] == ["ab", "cd"]


def test_title_case_and_json_without_python(spark):
    register(spark)
    texts = ["", None, "the end of a/the straße, is\nßa (of the) x", '{"a": [1, "b: {"], "c": {"d": "it\'s"}}', "{" * 700 + ":x,}", ", the"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    df.createOrReplaceTempView("said")
    out = spark.sql("SELECT k, fn_title_case(s) AS t, fn_json_formatter(s) AS j FROM said")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == sorted(df.select("k", fn.title_case("s"), fn.json_formatter("s")).collect())
