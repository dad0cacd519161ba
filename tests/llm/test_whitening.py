"""Whitening against plain NumPy and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from matchloom.llm import queries, whitening

ROWS = "vec_id long, embedding array<float>"


def expected(rows):
    """vec_id to (n, deviation, whitened up to sign), and the shares of the variance."""
    known = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in known})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    means = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(x, means)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k, x in known:
        away = np.array([float(c - m) for c, m in zip(x, means)])
        out[k] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), away @ vectors[:, :4] / np.sqrt(values[:4]))
    return out, values[:4] / values.sum()


def test_like_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(9, 9))
    rows = [(k, (rng.normal(size=9) @ mix * 0.1 + 0.3).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(100)] + [rows[5], (2000, None), (2001, [math.nan] + [0.0] * 8), (2002, [None] + [0.0] * 8), (2003, [math.inf] + [0.0] * 8)]
    spark.createDataFrame(rows, ROWS).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path)).collect()
    want, shares = expected(rows)
    assert len(got) == 401 * 4 and {r.vec_id for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, white = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        value = white[r.component - 1]
        if abs(value) > 1e-6:
            assert signs.setdefault(r.component, math.copysign(1, value * r.whitened)) == math.copysign(1, value * r.whitened)
        assert abs(abs(r.whitened) - abs(value)) < 1e-7
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def whiten(spark, rows):
    return whitening.whiten(spark.createDataFrame(rows, f"{ROWS}, component string")).collect()


def test_no_variance(spark):
    assert whiten(spark, []) == [] == whiten(spark, [(1, [], ""), (2, None, "")])
    assert [tuple(r) for r in whiten(spark, [(1, [0.5, 1.0], ""), (None, [0.5, 1.0], "")])] == [(k, c, 1, 0, None, None, None) for k in (1, None) for c in (1, 2)]
    line = whiten(spark, [(1, [0.0, 0.0], ""), (2, [1.0, 0.0], ""), (3, [-0.0], "")])
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in line] == [(k, c, 2, 256**2) for k in (1, 2, 3) for c in (1, 2)]
    assert [abs(r.whitened) if r.whitened is not None else None for r in line] == [1, None] * 3 and [r.explained for r in line] == [1, 0] * 3


def test_beyond_long(spark):
    rows = whiten(spark, [(1, [3e38, 1.0], ""), (2, [-3e38, 2.0], ""), (3, [1.0, 5.0], "")])
    assert {r.n for r in rows} == {3} and max(r.deviation for r in rows) == (1 << 63) - 1 and len(rows) == 6


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 30, 1 << 40])
def test_deviation_is_exact(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, (200, 6))
    for n in (7, 1000, 1 << 33):
        sums = [int(s) * n // 200 for s in x.astype(object).sum(0)]
        model = whitening.Whitening(n, sums, np.zeros(6), np.zeros((6, 0)), [], None)
        want = [min(sum((n * int(c) - s) ** 2 for c, s in zip(v, sums)), (1 << 63) - 1) for v in x]
        assert model.deviation(x).tolist() == want


def test_sums_are_exact():
    x = np.full((5, 2), (1 << 62) + 3)
    assert whitening.exact_sum(x).tolist() == [5 * ((1 << 62) + 3)] * 2


def test_moments_of_parts():
    w = np.random.default_rng(1).normal(size=(50, 3)) + 10
    n, mean, c = whitening.joined(whitening.joined(whitening.moments(w[:7]), whitening.moments(w[7:30])), whitening.moments(w[30:]))
    assert n == 50 and np.allclose(mean, w.mean(0)) and np.allclose(c / n, np.cov(w.T, bias=True))
