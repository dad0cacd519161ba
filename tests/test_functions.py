"""Golden values, the matrix of nulls, and properties of the functions."""

import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom import functions as fn
from matchloom.functions import strings
from matchloom.functions import distance, patterns

from . import one_by_one
from .one_by_one import json_text, title_text


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def lits(*pair):
    return [F.lit(x).cast("string") for x in pair]


def test_distances(spark):
    cases = {
        fn.levenshtein_distance: [("Athena", "Athena", 0), ("Heracles", "Hercules", 2), ("Prometheus", "Hephaestus", 8), ("é ", "e", 0), ("E", "e", 1)],
        fn.osa_distance: [("Athena", "Athena", 0), ("Herucles", "Hercules", 1), ("Heracles", "Hercules", 2), ("Prometheus", "Hephaestus", 8), ("ca", "abc", 3)],
        fn.damerau_levenshtein_distance: [("kitty", "litter", 3), ("damerau", "demarera", 4), ("Damerau", "demarera", 5), ("ca", "abc", 2), ("a bc", "a cb", 1)],
        fn.jaro_similarity: [("virtuoso", "viscous", Decimal("0.71309524"))],
        fn.jaro_winkler_similarity: [("virtuoso", "viscous", Decimal("0.77047619")), ("virtuoso", "virtuous", Decimal("0.95000000"))],
    }
    for function, rows in cases.items():
        assert values(spark, *(function(*lits(a, b)) for a, b, _ in rows)) == [x for *_, x in rows]


def test_predicates(spark):
    cases = [
        ("exact", "Lan Zhan", "Lan Zhan", 1, True), ("exact", "Lan Zhan", "Lan Zhan", 0, False), ("exact", "Lan Zhan", "Lan Xichen", 1, False),
        ("levenshtein", "Athena", "Athena", 0, True), ("levenshtein", "Heracles", "Hercules", 1, False), ("levenshtein", "Heracles", "Hercules", 2, True),
        *((name, "kitty", "litter", t, t == 3) for name in ("levenshtein_low", "osa", "osa_low", "damerau_levenshtein") for t in (2, 3)),
        *((f"{name}_normalised", "Saturday", "Sunday", t, t == "0.4") for name in ("levenshtein", "osa", "damerau_levenshtein", "osa_low", "levenshtein_low") for t in ("0.3", "0.4")),
        ("levenshtein_low_normalised", "sat", "sun", "1.0", True), ("levenshtein_low_normalised", "sat", "sun", "0.9", True),
        ("jaro", "virtuoso", "viscous", "0.7", True), ("jaro", "virtuoso", "viscous", "0.8", False),
        ("jaro_winkler", "virtuoso", "viscous", "0.9", False), ("jaro_winkler", "virtuoso", "virtuous", "0.9", True),
    ]
    assert values(spark, *(fn.PREDICATES[name](*lits(a, b), t) for name, a, b, t, _ in cases)) == [x for *_, x in cases]


PAIRS = [(None, None), (None, "abc"), ("abc", None), ("", None), (None, ""), ("", "")]
MATRIX = [
    *((name, None, [2147483647, 3, 3, None, 0, 0]) for name in ("levenshtein_distance", "osa_distance", "damerau_levenshtein_distance")),
    *((name, None, [0, 0, 0, 0, 0, 1]) for name in ("jaro_similarity", "jaro_winkler_similarity")),
    ("exact", 1, [0, 0, 0, 0, 0, 1]),
    ("levenshtein", 3, [0, 1, 1, 0, 1, 1]), ("levenshtein", 2, [0, 0, 0, 0, 1, 1]),
    *((name, t, [0, t >= 3, t >= 3, 1, 1, 1]) for name in ("levenshtein_low", "osa_low") for t in (2, 3)),
    *((name, "0.5", [0, 0, 0, 0, 0, 1]) for name in ("levenshtein_normalised", "osa_normalised", "damerau_levenshtein_normalised")),
    *((name, 1, [1, 1, 1, 1, 1, 1]) for name in ("levenshtein_normalised", "osa_normalised", "damerau_levenshtein_normalised")),
    *((name, "0.5", [0, 1, 0, 0, 1, 1]) for name in ("levenshtein_low_normalised", "osa_low_normalised")),
    *((name, 1, [0, 1, 1, 0, 1, 1]) for name in ("levenshtein_low_normalised", "osa_low_normalised")),
    *((name, t, [0, t >= 3, t >= 3, 0, 1, 1]) for name in ("osa", "damerau_levenshtein") for t in (2, 3)),
    *((name, "0.5", [0, 0, 0, 0, 0, 1]) for name in ("jaro", "jaro_winkler")),
    *((name, 0, [0, 0, 0, 0, 0, 1]) for name in ("levenshtein", "levenshtein_low", "levenshtein_normalised", "osa_low", "osa_normalised", "damerau_levenshtein_normalised")),
    *((name, 0, [0, 0, 0, 0, 1, 1]) for name in ("osa", "damerau_levenshtein")),
    *((name, 0, [1, 1, 1, 1, 1, 1]) for name in ("jaro", "jaro_winkler")),
    *((name, -1, [0, 0, 0, 0, 0, 0]) for name in ("levenshtein", "levenshtein_low", "levenshtein_normalised", "osa", "osa_low", "osa_normalised", "damerau_levenshtein")),
    *((name, -1, [0, 1, 0, 0, 1, 1]) for name in ("levenshtein_low_normalised", "osa_low_normalised")),
]


@pytest.mark.parametrize(("name", "threshold", "expected"), MATRIX)
def test_nulls(spark, name, threshold, expected):
    if threshold is None:
        function = getattr(fn, name)
        found = values(spark, *(function(*lits(a, b)) for a, b in PAIRS))
        assert [x if x is None else int(x) for x in found] == expected
    else:
        assert values(spark, *(fn.PREDICATES[name](*lits(a, b), threshold) for a, b in PAIRS)) == [bool(x) for x in expected]


words = st.text("abcé ", max_size=8)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(words, words, st.integers(0, 6))
def test_distance_properties(a, b, most):
    o, d = one_by_one.osa(a, b), one_by_one.damerau(a, b)
    assert o == one_by_one.osa(b, a) and d == one_by_one.damerau(b, a)
    assert d <= o <= plain(a, b)
    assert (o == 0) == (a == b) == (d == 0)
    assert one_by_one.osa(a, b, most) == min(o, most + 1)
    assert 0 <= one_by_one.jaro(a, b) <= 1 and one_by_one.jaro(a, a) == 1


@pytest.mark.parametrize("cells", [distance.CELLS, 60])
def test_many_pairs_like_one_by_one(monkeypatch, cells):
    monkeypatch.setattr(distance, "CELLS", cells)
    rng = random.Random(3)
    a = ["".join(rng.choice("abcd\0é😀") for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(1500)]
    b = ["".join(x if rng.random() < 0.8 else rng.choice("abcd") for x in t)[rng.randint(0, 2) :] + rng.choice(["", "ba"]) if rng.random() < 0.7 else rng.choice(a) for t in a]
    b = [t[1] + t[0] + t[2:] if len(t) > 1 and rng.random() < 0.3 else t for t in b]
    most = np.array([rng.choice([0, 1, 2, 3, 5, 40]) for _ in a])
    for many, one in ((distance.osa_many, one_by_one.osa), (distance.damerau_many, one_by_one.damerau), (distance.jaro_many, one_by_one.jaro)):
        whole = [one(x, y) for x, y in zip(a, b)]
        assert many(a, b).tolist() == pytest.approx(whole, abs=1e-12)
        if many is not distance.jaro_many:
            assert many(a, b, most).tolist() == [min(d, t + 1) for d, t in zip(whole, most.tolist())]
        assert many([], []).tolist() == []


def test_thresholds_do_not_change_verdicts(spark):
    names = [None, "", "a", "ab", "ba", "abc", "martha", "marhta", "dwayne", "duane", "dixon", "dicksonx", "ca", "abcdefgh", "abdcefhg"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for t in (0, 1, 2, 4):
        for n in ("osa", "damerau_levenshtein"):
            assert pairs.where(fn.PREDICATES[n]("a", "b", t) != F.coalesce(getattr(fn, n if n != "osa" else "osa_distance", fn.damerau_levenshtein_distance)("a", "b") <= t, F.lit(False))).count() == 0
    for t in ("0.2", "0.5", "0.9", "0.961111", "0.99"):
        assert pairs.where(fn.PREDICATES["jaro"]("a", "b", t) != (fn.jaro_similarity("a", "b") >= Decimal(t))).count() == 0
        assert pairs.where(fn.PREDICATES["jaro_winkler"]("a", "b", t) != (fn.jaro_winkler_similarity("a", "b") >= Decimal(t))).count() == 0


def test_low_rules_equal_plain_rules(spark):
    names = ["", "a", "ab", "ba", "abc", "acb", "cab", "xyz", "abcd", "é", None]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a is not None and b is not None], "a string, b string")
    for t in (1, 2):
        both = [(fn.PREDICATES[f"{n}_low"]("a", "b", t), fn.PREDICATES[n]("a", "b", t)) for n in ("levenshtein", "osa")]
        assert pairs.where((both[0][0] != both[0][1]) | (both[1][0] != both[1][1])).count() == 0


def test_strings(spark):
    long = "the life-changing MAGIC of tidying up: the japanese sEnSAtiOn - over 3 million copies sold"
    cases = [
        (fn.age(F.lit(date(1999, 10, 3)), date(2024, 1, 6)), 24),
        (fn.age(F.lit(date(2004, 2, 29)), date(2023, 2, 28)), 18),
        (fn.age(F.lit(date(2024, 1, 6)), date(1999, 10, 3)), -24),
        (fn.age(F.lit(None).cast("date"), date(2024, 1, 6)), None),
        (fn.extract_param(F.lit("server=<server>;database=<database>"), "database_"), "<database>"),
        (fn.extract_param(F.lit("a=1;b="), "b="), ""),
        (fn.extract_param(F.lit("a=1;b=2"), "c="), None),
        (fn.extract_param(F.lit("a=1;b=2"), "[ab]=", include_key=True), "a=1"),
        (fn.extract_pattern(F.lit("Execute Order 66")), "EO66"),
        (fn.extract_pattern(F.lit("12ab34 "), "[0-9][0-9]", 2), "1"),
        (fn.fingerprint(F.lit("F1inger-PR!INT")), "f1ingerprint"),
        (fn.fingerprint(F.lit("Éa é")), "éaé"),
        (fn.replace_all(F.lit("Replace Old Text"), "Old", "New", strict=False), "Replace New Text"),
        (fn.replace_all(F.lit("Replace New Text"), "New", "Newer", strict=True), "Replace Newer Text"),
        (fn.replace_all(F.lit("Replace Newer Text"), "New", "Newer", strict=True), "Replace Newer Text"),
        (fn.replace_all(F.lit("Three   spaces."), "  ", " ", strict=False), "Three spaces."),
        (fn.replace_all(F.lit("2024-01-01"), "[^0-9]", "", strict=False), "20240101"),
        (fn.replace_all(F.lit("12-3456"), "[0-9]", "1a", strict=False), "1a1a-1a1a1a1a"),
        (fn.replace_all(F.lit("aabb"), "ab", "", strict=False), ""),
        (fn.replace_all(F.lit("abc"), None, "x"), "abc"),
        (fn.replace_all(F.lit("abc"), "b", None), None),
        (fn.start_case(F.lit("semi-EULERIAN gRaPh")), "Semi-Eulerian Graph"),
        (fn.start_case(F.lit("a/b ßx")), "A/b ßx"),
        (fn.title_case(F.lit(long)), "The Life-Changing Magic of Tidying Up: The Japanese Sensation - Over 3 Million Copies Sold"),
        (fn.title_case(F.lit("")), None),
        (fn.string_split_item(F.lit("Link,Zelda,Ganondorf"), ",", 1), "Zelda"),
        (fn.string_split_item(F.lit("a;b"), ";", 1), "b"),
        (fn.string_split_item(F.lit("a;b"), ";", 9), ""),
        (fn.string_split_item(F.lit(None).cast("string")), ""),
        (fn.gradient_hex(F.lit(1), 0, 2, "#000000", "#FFFFFF"), "#7F7F7F"),
        (fn.gradient_hex(F.lit(1), 1, 1, "#000000", "#FFFFFF"), "#000000"),
        (fn.gradient_hex(F.lit(3), 0, 2, "#000", "#FFF"), "#7E7E7E"),
        (fn.gradient_hex(F.lit(None).cast("double"), 0, 2, "#000000", "#FFFFFF"), None),
    ]
    assert values(spark, *(c for c, _ in cases)) == [x for _, x in cases]


def test_row_functions(spark):
    rows = lambda c: [tuple(r) for r in spark.range(1).select(F.inline(c)).collect()]
    assert rows(fn.split_rows(F.lit("Link, Zelda ,Ganondorf"))) == [("Link", 0), ("Zelda", 1), ("Ganondorf", 2)]
    assert rows(fn.split_rows(F.lit(""))) == [("", 0)]
    assert rows(fn.split_rows(F.lit(None).cast("string"))) == []
    assert rows(fn.split_rows(F.lit("a||b"), "||")) == [("a", 0), ("b", 1)]
    assert rows(fn.hexcode_to_rgb(F.lit("#181848"))) == [("r", 24), ("g", 24), ("b", 72)]
    assert rows(fn.hexcode_to_rgb(F.lit("#1a8"))) == [("r", 17), ("g", 170), ("b", 136)]
    assert rows(fn.hexcode_to_rgb(F.lit("#12345"))) == []
    assert rows(fn.hexcode_to_rgb(F.lit(None).cast("string"))) == [("r", None), ("g", None), ("b", None)]


def test_json():
    text = '{"game": ["Super", "Mario"], "moons": 880, "b": {"c": "x, {y}: \\" z"}, "e": {}}'
    assert json_text(text) == '{\n\t"game": [\n\t\t"Super",\n\t\t"Mario"\n\t],\n\t"moons": 880,\n\t"b": {\n\t\t"c": "x, {y}: \\" z"\n\t},\n\t"e": {\n\t}\n}'
    assert json_text("") == "" and json_text("1.50") == "1.50"


def test_title_words():
    assert title_text("for,the end of all") == "For,the End of All"
    assert title_text("a (the) b") == "A (The) B"


def test_patterns():
    assert patterns.width("[^a-z]_x") == 3
    assert patterns.compiled("[a-c]").fullmatch("é") is None and patterns.compiled("[a-f]").fullmatch("é")
    assert patterns.compiled("e%x").search("é..x") and not patterns.compiled("a.c").search("abc")


def test_title_case_and_windows_without_python(spark):
    """The column functions against the plain ones, on texts of all the characters that matter."""
    rng = random.Random(4)
    words = ["the", "of", "a", "straße", "ßa", "élan", "x", "", "is", "THE", "Of"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", ".", "! ", "/", "-", "\\", "(", " [", "\n", ",,", " ", " "]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += ["", " ", ",", "of", "of ", " the", ". the of", "a/the", None, "A1b2  ", "12 ", " 1", "1", "a" * 5 + "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    out = df.select("k", fn.title_case("s").alias("t"), fn.extract_pattern("s", "[a-z][a-z]", 2).alias("w"), fn.extract_pattern("s", "[a-z ][. ][a-z]", 3).alias("v"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        x = texts[r.k]
        assert r.t == (None if x is None else title_text(x)), x
        assert (r.w, r.v) == ((None, None) if x is None else (strings.extract_pattern_text(x, "[a-z][a-z]", 2), strings.extract_pattern_text(x, "[a-z ][. ][a-z]", 3))), x


def test_json_and_settled_texts_without_python(spark):
    """Layout and replacing to the end as expressions, against the plain loops."""
    rng = random.Random(9)
    marks = ["{", "}", "[", "]", ":", ",", '"', '"a b"', '"x\\\\"', '"\\"{,"', "\\", " ", "\n", "\t", "1.50", "null", "é", "\u00a0", "\x1d", "{}", "[]"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["", " ", "\n", "1.50", None, '{"k": [' + ", ".join(['{"a": "b\\"c"}'] * 3000) + "]}", '"' + '\\"' * 50_000 + '"', '"' + "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    out = df.select("k", fn.json_formatter("s").alias("j"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r.j == (None if texts[r.k] is None else json_text(texts[r.k])), texts[r.k][:200]
    rules = [("ab", ""), ("ab", "ba"), ("aab", "b$\\"), ("[a-b]c", "c"), ("b[ab]", "a"), ("aa", "b")]
    texts = ["".join(rng.choice("aabbcd") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None, "a" * 500 + "b" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    out = df.select("k", *(fn.replace_all("s", a, b, False).alias(f"r{n}") for n, (a, b) in enumerate(rules)))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        for n, (a, b) in enumerate(rules):
            assert r[f"r{n}"] == (None if texts[r.k] is None else strings.replace_text(texts[r.k], a, b, False)), (texts[r.k], a, b)
    assert values(spark, fn.replace_all(F.lit("xab"), "ab", "bbaa", False)) == ["xbbaa"]
    with pytest.raises(Exception, match="does not settle"):
        values(spark, fn.replace_all(F.lit("abb"), "ab", "bbaa", False))
