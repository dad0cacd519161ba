"""Candidate pairs against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.predicates import PREDICATES
from matchloom.operators import candidates, match

_NAMES = "anna hannah joanna johanna jon john johan marta martha mathar maria mary élise elise ELISE stéphane stefan ab ba a".split()


def names(n, seed):
    """Texts of 0 to 30 characters, many of them a few edits or swaps apart."""
    rng = random.Random(seed)
    out = {"", " ", "é", "e", "e ", "ﬁnn", "finn"}
    while len(out) < n:
        text = list(" ".join(rng.choice(_NAMES) for _ in range(rng.randint(1, 4)))[:30])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                text.insert(at, rng.choice("aeonx"))
            elif kind == 1 and at + 1 < len(text):
                text[at], text[at + 1] = text[at + 1], text[at]
            elif kind == 2 and at < len(text):
                del text[at]
            elif at < len(text):
                text[at] = rng.choice("aeonx")
        out.add("".join(text))
    return sorted(out)


RULES = [
    ("levenshtein_low", "2"), ("levenshtein", "5"), ("levenshtein_normalised", "0.3"), ("levenshtein_low_normalised", "0.25"), ("osa", "1"), ("osa_low", "3"),
    ("osa_normalised", "0.2"), ("osa_low_normalised", "0.35"), ("damerau_levenshtein", "2"), ("damerau_levenshtein_normalised", "0.25"), ("jaro", "0.8"), ("jaro", "0.9"), ("jaro_winkler", "0.85"), ("jaro_winkler", "0.97"),
]


@pytest.mark.parametrize(("function", "threshold"), RULES)
def test_no_pair_is_lost(spark, monkeypatch, function, threshold):
    monkeypatch.setattr(candidates, "PLAIN", 20)
    monkeypatch.setattr(candidates, "PLAIN_IN_PYTHON", 20)
    monkeypatch.setattr(candidates, "SLICE", 7)
    values = spark.createDataFrame([(1, x) for x in names(160, 1)] + [(2, x) for x in names(15, 2)], "g int, value string")
    how = candidates.filter_of(function, threshold)
    rows = [tuple(r) for r in candidates.near(values, ["g"], function, threshold, how, False).collect()]
    got = set(rows)
    assert len(got) == len(rows)
    a, b = values.select("g", F.col("value").alias("a")), values.select("g", F.col("value").alias("b"))
    all_pairs = a.join(b, "g").select("g", "a", "b")
    want = {tuple(r) for r in all_pairs.where(PREDICATES[function](F.col("a"), F.col("b"), threshold)).collect()}
    assert got == want and len(want) > values.count()  # not only each with itself


@pytest.mark.parametrize("rules", ["v,osa_low,2;w,exact,1", "v,jaro_winkler,0.9;w,exact,1,a", "v,levenshtein_low,1;w,levenshtein,0,a;v,jaro,0.5", "v,levenshtein,2,a;w,exact,1"])
def test_match_like_all_pairs(spark, monkeypatch, rules):
    monkeypatch.setattr(candidates, "PLAIN", 10)
    monkeypatch.setattr(candidates, "PLAIN_IN_PYTHON", 10)
    monkeypatch.setattr(candidates, "SLICE", 6)
    rng = random.Random(5)
    known = names(60, 3)
    rows = [(k, rng.choice("xyz"), rng.choice([None, *known, *["joanna"] * 20]), rng.choice([None, "p", "q", "Q"])) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, b string, v string, w string").repartition(3)
    got = sorted((r.l_id, r.r_id) for r in match(df, "id", F.col("b"), None, rules).collect())
    pairs = df.select(*(F.col(c).alias(f"l_{c}") for c in df.columns)).join(df.select(*(F.col(c).alias(f"r_{c}") for c in df.columns)), (F.col("l_b") == F.col("r_b")) & (F.col("l_id") < F.col("r_id")))
    for rule in rules.split(";"):
        column, function, threshold, *allow = rule.split(",")
        null = F.col(f"l_{column}").isNull() | F.col(f"r_{column}").isNull()
        holds = PREDICATES[function](F.col(f"l_{column}"), F.col(f"r_{column}"), threshold)
        pairs = pairs.where((null | holds) if allow else (~null & holds))
    want = sorted((r.l_id, r.r_id) for r in pairs.select("l_id", "r_id").collect())
    assert got == want and len(want) > 20


@pytest.mark.parametrize(("function", "threshold"), [("levenshtein_low", "1"), ("jaro_winkler", "0.97")])
def test_a_large_block_is_not_paired_in_full(spark, function, threshold):
    """20,000 names of one block: 200 million pairs, of which the index offers few."""
    rng = random.Random(9)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    made = sorted({"".join(rng.choice(syllables) for _ in range(7)) + (f"#{k}" if k % 2 else "") for k in range(20_000)})
    made += [made[k][:5] + "x" + made[k][6:] for k in range(0, 20_000, 100)]
    values = spark.createDataFrame([(1, x) for x in sorted(set(made))], "g int, value string")
    found = candidates.candidates(values, ["g"], candidates.filter_of(function, threshold), True)
    offered = found.count() - values.count()
    assert 150 < offered < 4_000_000, offered


def test_thresholds_without_a_filter():
    assert [candidates.filter_of(*x) for x in (("jaro", "0.6"), ("osa", "-1"), ("levenshtein_normalised", "1"), ("exact", "1"))] == [None] * 4


def test_numbered_names_of_one_block_are_not_paired_by_their_digits_alone(spark):
    """Names that differ in six digits: few have the same digits or the same rest without one of them, but most share their rarest two."""
    rng = random.Random(4)
    values = spark.createDataFrame([(1, f"Customer#{k:09d}") for k in sorted(rng.sample(range(900_000), 4000))], "g int, value string")
    offered = candidates.candidates(values, ["g"], candidates.filter_of("jaro_winkler", "0.97"), False).count() - 4000
    assert 2000 < offered < 40_000, offered  # all bags that share 17 of 18 characters: 110,861
