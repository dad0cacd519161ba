"""Top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from matchloom.llm import topk

ROWS = "vec_id long, embedding array<float>"


def brute(rows, top=20, every=20):
    known = []
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((k, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = set()
    for q, u in known:
        if q % every == 0:
            clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
            scores = sorted((-clip(sum(x * y for x, y in zip(u, v))), k) for k, v in known if k != q)
            out |= {(q, rank, k, -s) for rank, (s, k) in enumerate(scores[:top], 1)}
    return out


def found(spark, rows, **more):
    return {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, ROWS).repartition(3), **more).collect()}


@pytest.mark.parametrize(("scale", "shift"), [(1, 0), (0.05, 0.02), (1, -2)])
def test_like_brute_force(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(k, (scale * (centres[k % 6] + 0.5 * rng.normal(size=12)) + shift).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)]  # one vector often: ties
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (20, [0.25, -1.0]), (1, [1.0, float("nan")]), (2, [None, 1.0]), (3, None), (4, []), (5, [2.0]), (6, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set() and found(spark, [(0, [1.0])]) == set()
    assert found(spark, [(0, [3e8, 1.0]), (1, [5e8, 1.0]), (2, [-4e8, 2.0])]) == brute([(0, [3e8, 1.0]), (1, [5e8, 1.0]), (2, [-4e8, 2.0])])


def test_search_in_any_order_and_small_k(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(5)]) for k in range(130)]
    assert found(spark, rows, top=3, every=10) == brute(rows, 3, 10)


@pytest.mark.parametrize("spread", [0.2, 1, 5])
def test_pruning_keeps_all_winners(spread):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    vectors = np.floor(64 * (centres[rng.integers(0, 20, 5000)] + spread * rng.normal(size=(5000, 32))) / 6)
    ids, queries = rng.permutation(5000), vectors[::50]
    best = np.full((len(queries), 5), -np.inf)
    seen = {k: [] for k in range(len(queries))}
    for a in range(0, 5000, 1250):
        for k, i, s in zip(*topk.search(ids[::50], queries, topk.Shard(ids[a : a + 1250], vectors[a : a + 1250]), best, 5)):
            seen[k].append((-int(s), int(i)))
    for k, q in enumerate(queries):
        scores = sorted((-int(q @ v), int(i)) for v, i in zip(vectors, ids) if i != ids[50 * k])
        assert sorted(seen[k])[:5] == scores[:5]
        assert best[k].tolist() == [-s for s, _ in scores[:5]]


def test_lists_are_passed_over_and_terms_spared(spark):
    """Through the operator, with its own parameters: most multiplications of clustered vectors are not made."""
    rng = np.random.default_rng(8)
    vectors = (0.02 * rng.normal(size=(24_000, 32))).astype(np.float32)
    vectors[np.arange(24_000), np.arange(24_000) % 8] += rng.uniform(0.8, 1.2, 24_000).astype(np.float32)
    totals = {name: spark.sparkContext.accumulator(0.0) for name in topk.WORK}
    got = found(spark, list(enumerate(vectors.tolist())), every=400, count=lambda name, much: totals[name].add(much))
    whole = np.floor(64 * vectors.astype(float))
    wanted = set()
    for q in range(0, 24_000, 400):
        score = whole @ whole[q]
        others = np.lexsort((np.arange(24_000), -score))
        wanted |= {(q, rank, int(k), int(score[k])) for rank, k in enumerate(others[others != q][:20], 1)}
    assert got == wanted
    told = {name: x.value for name, x in totals.items()}
    assert told["made"] < 0.5 * told["all"] and told["passed"] > 0.5 * told["lists"] > 0, told


def test_terms_are_spared(monkeypatch):
    """Lists whose first terms carry the scores: the others are probed for few rows."""
    rng = np.random.default_rng(4)
    q, v = np.floor(64 * rng.normal(size=(5, 32)) * np.r_[np.full(4, 4.0), np.full(28, 0.1)]), np.floor(64 * rng.normal(size=(900, 32)) * np.r_[np.full(4, 4.0), np.full(28, 0.1)])
    scores = q @ v.T
    threshold = -np.sort(-scores, 1)[:, 9]
    work = np.zeros(len(topk.WORK))
    row, place, score = topk._traverse(q, v, v.min(0), v.max(0), threshold, work)
    assert {(int(a), int(b)): float(c) for a, b, c in zip(row, place, score)} == {(a, b): scores[a, b] for a, b in zip(*np.nonzero(scores >= threshold[:, None]))}
    assert work[1] < 0.6 * q.size * len(v)


def test_query_rows_of_one_id_share_a_list(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), *((k, [k / 100, 1 - k / 100]) for k in range(1, 20))]
    pairs = sorted((-sum(math.floor(64 * float(np.float32(x))) * math.floor(64 * float(np.float32(y))) for x, y in zip(u, v)), k) for q, u in rows if q == 20 for k, v in rows if k != 20)
    assert found(spark, rows, top=5) == {(20, rank, k, -s) for rank, (s, k) in enumerate(pairs[:5], 1)}
