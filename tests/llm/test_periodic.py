"""Runs of periodic words against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import DOCUMENTS, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import columnar, periodic, queries


def brute(words, least):
    """Every stretch that is maximal for some period, with its smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def fast(texts, least):
    runs, _, _ = periodic.runs_of(*arrays(texts), least)
    return [[tuple(r[1:]) for r in runs.tolist() if r[0] == k] for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=5), st.integers(2, 13))
def test_runs_of_small_alphabets(rows, least):
    assert fast([" ".join(r) for r in rows], least) == [brute(r, least) for r in rows]


def test_structured_words():
    fib, thue = ["a", "b"], "a"
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    for _ in range(9):
        thue += thue.translate({97: "b", 98: "a"})
    texts = [list(fib[-1]), list(thue), ["x"] * 400, list("abcdefg" * 40), list("abc" * 30) + list(fib[-1][:50]) * 3]
    assert fast([" ".join(t) for t in texts], 12) == [brute(t, 12) for t in texts]


def test_candidates_in_slices(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 7)
    rng = random.Random(1)
    texts = [[rng.choice("ab") for _ in range(90)] for _ in range(3)]
    assert fast([" ".join(t) for t in texts], 6) == [brute(t, 6) for t in texts]


def test_far_repeats_are_masked_away():
    """A passage told twice, far apart, and lines in common with other texts leave no segment."""
    rng = random.Random(2)
    other = [f"w{rng.random()}" for _ in range(500)]
    passage = [f"p{k}" for k in range(40)]
    data, offsets = arrays([" ".join(passage + other + passage), " ".join(passage)])
    start, end = columnar.words(data, offsets)
    at, _ = periodic.segments(columnar.span_hashes(data, start, end), columnar.rows_of(start, offsets), 12)
    assert not len(at)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[0], best[1], best[2], math.floor(1000 * best[1] / best[2])) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept(words, runs)))


def test_query_like_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = [rng.choice("the of and to a in is it".split()) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 120))]
        if k % 9 == 0:
            words[5:5] = [f"q{k % 4}", "x", "yé"] * rng.randint(3, 9)
        rows.append((k, rng.choice([" ", "\n", "\t ", "  "]).join(words), "en", "s", 0))
    rows += [rows[9], (None, "a b " * 20, None, None, None), (-17, "a b " * 20, None, None, None), (10_000, "x " * 30_000 + "end", None, None, None)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).collect()]
    long = [r for r in got if r[0] == 10_000]
    assert sorted((r for r in got if r[0] != 10_000), key=repr) == sorted((expected(*r[:2]) for r in rows if r[0] != 10_000), key=repr)
    assert len(long) == 1 and long[0][1] == 1
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 20


def test_odd_rows(spark):
    docs = odd_rows(spark, "runs string")
    out = {(r.doc_id, r.n_runs, r.collapsed) for r in periodic.find(docs).collect()}
    assert len(periodic.find(docs).collect()) == docs.count()
    assert {(0, 0, ""), (1, 0, ""), (3, 0, ""), (6, 1, "a"), (None, 0, "")} <= out
    assert periodic.find(docs.limit(0)).collect() == []


@pytest.mark.parametrize("least", [2, 5])
def test_spans(spark, least):
    docs = spark.createDataFrame([(1, "go a b a b a b stop  x\n")], "doc_id long, text string")
    row = periodic.find(docs, F.col("text"), least).collect()[0]
    assert [tuple(r) for r in row.runs] == [(1, 6, 2)] and row.collapsed == "go a b stop x"
