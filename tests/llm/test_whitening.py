import math

import numpy as np
import pytest

from quarry.llm import whitening


def check(rows, got, k, scale=256.0):
    """Against numpy's eigenvectors of the whole covariance matrix."""
    x = [[math.floor(scale * c) for c in v] for _, v in rows]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit - s / n).astype(float)
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    z = (np.array(x, dtype=float) - (s / n).astype(float)) @ w[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        mine = np.array([by[c + 1][i][0].whitened for i, _ in rows])
        sign = np.sign(mine @ z[:, c])
        assert np.abs(sign * mine - z[:, c]).max() < 1e-8
        for (i, _), q in zip(rows, x, strict=True):
            for r in by[c + 1][i]:
                assert (r.n, r.deviation) == (n, sum((n * a - b) ** 2 for a, b in zip(q, s, strict=True)))
                assert r.explained == pytest.approx(e[c] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize(("d", "block"), [(6, 32), (40, 12), (40, 6)])
def test_equals_eigenvectors(spark, d, block):
    rng = np.random.default_rng(d)
    x = (rng.normal(0, 1, (400, d)) * np.concatenate([[3, 2.5, 2, 1.7], np.linspace(1, 0.5, d - 4)]) + 5).round(3)
    x[50:70] = x[49]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, n int").repartition(5)
    check(rows, whitening.whiten(df, block=block).collect(), 4)


def test_rows_that_take_no_part_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, -1.5]), (2, [0.5, 0.25, 3.0]), (3, [1.0, 2.0, -1.5]), (4, [-2.0, 0.1, 0.0]), (5, [7.0, -3.0, 1.0]), (6, [-0.0, 0.0, 0.0])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [1.0, inf, 1.0]), (11, []), (12, [1.0, 2.0]), (13, [1e300, 0.0, 0.0]), (None, None)]
    schema = "vec_id long, embedding array<double>"
    got = whitening.whiten(spark.createDataFrame(good + bad, schema)).collect()
    check(good, got, 3)  # three dimensions have three components
    repeated = whitening.whiten(spark.createDataFrame(good + good, schema)).collect()
    assert len(repeated) == 2 * len(got) and {r.n for r in repeated} == {5}
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    check(flat, whitening.whiten(spark.createDataFrame(flat, schema)).collect(), 1)  # all on a line
    for none in ([], bad[:3], [(1, [1.0, 1.0])] * 4):
        out = whitening.whiten(spark.createDataFrame(none, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(i, [float((i * 7919) % 1009) * 3.0, float((i * 31) % 997), float(i % 2)]) for i in range(300)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), 3)
    huge = [(i, [float(i) * 2.0**40, 1.0]) for i in range(40)]
    with pytest.raises(Exception, match="(?i)overflow|too large|int64|convert"):
        whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()


def test_passes_are_few_and_certified(spark, monkeypatch):
    """With close eigenvalues the filter saves passes; residuals are those of the true covariance."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 1, (3000, 60)) * np.linspace(60, 50, 60))
    fit = spark.createDataFrame([([int(c) for c in v],) for v in x], "x array<long>")
    calls = []
    inner = whitening.covariance_times
    monkeypatch.setattr(whitening, "covariance_times", lambda *a: calls.append(1) or inner(*a))
    mean = x.mean(axis=0)
    values, u = whitening.components(fit, mean, len(x), 4, 24, 1e-12, 500)
    v = (x - mean).T @ (x - mean) / len(x)
    assert np.linalg.norm(v @ u - u * values, axis=0).max() <= 1e-11 * values[0] and len(calls) < 100
    with pytest.raises(RuntimeError):
        whitening.components(fit, mean, len(x), 4, 6, 1e-12, 3)
