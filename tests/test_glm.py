"""Poisson fits against Newton steps in numpy, and what must be refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import glm


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3_000, 2)) * [1.0, 5.0] + [0.0, 20.0]
    o = draw.uniform(0, 1, 3_000)
    y = draw.poisson(np.exp(o + 0.3 * x[:, 0] - 0.05 * x[:, 1]))
    data = [(float(a), float(b), float(c), float(d), i % 3) for i, ((a, b), c, d) in enumerate(zip(x, o, y))]
    return spark.createDataFrame(data, "a double, b double, o double, y double, fold int").repartition(5)


def newton(x, y, o, alpha=0.0):
    z, b = np.column_stack((np.ones(len(y)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(200):
        mu = np.exp(z @ b + o)
        fisher = z.T @ (z * mu[:, None]) + alpha * len(y) * np.eye(len(b))
        step = np.linalg.solve(fisher, z.T @ (y - mu) - alpha * len(y) * b)
        b = b + step * min(1, 2 / np.abs(step).max())
    return b, fisher


def arrays(rows):
    d = rows.toPandas()
    return d[["a", "b"]].to_numpy(), d.y.to_numpy(), d.o.to_numpy(), d.fold.to_numpy()


@pytest.mark.parametrize("alpha,standardize", [(0.0, False), (0.1, True), (0.02, False)])
def test_coefficients(rows, alpha, standardize):
    x, y, o, fold = arrays(rows)
    fits = glm.poisson(rows, ["a", "b"], "y", "o", alpha, standardize, "fold")
    assert sorted(fits, key=str) == [0, 1, 2, None]
    for k, fit in fits.items():
        at = np.ones(len(y), bool) if k is None else fold != k
        z = (x[at] - x[at].mean(0)) / x[at].std(0, ddof=1) if standardize else x[at]
        b, fisher = newton(z, y[at], o[at], alpha)
        assert fit.rows == at.sum() and np.allclose(fit.coef, b, atol=1e-8)
        assert alpha or np.allclose(fit.covariance, np.linalg.inv(fisher), rtol=1e-6)
        assert bool(alpha) == (fit.covariance is None)


def test_eta_and_arms(rows):
    """Out-of-fold rates are those of separate fits on the other folds, residual arm included."""
    x, y, o, fold = arrays(rows)
    d = rows.withColumn("id", F.monotonically_increasing_id())
    got = glm.crossfit_arms(d, ["a"], ["b"], "y", "o", "fold", (0.0, 0.1)).toPandas()
    for k in range(3):
        g, at = got[got.fold == k], fold != k
        base, _ = newton(x[at][:, :1], y[at], o[at])
        eta = lambda z, o: o + base[0] + base[1] * z[:, 0]
        m, s = x[at][:, 1].mean(), x[at][:, 1].std(ddof=1)
        more, _ = newton(((x[at][:, 1] - m) / s)[:, None], y[at], eta(x[at], o[at]), 0.1)
        z = g[["a", "b"]].to_numpy()
        assert np.allclose(g.lam_offset, np.exp(g.o) * y[at].sum() / np.exp(o[at]).sum())
        assert np.allclose(g.lam_seasonal, np.exp(eta(z, g.o.to_numpy())), rtol=1e-7)
        assert np.allclose(g.lam_full, np.exp(eta(z, g.o.to_numpy()) + more[0] + more[1] * (z[:, 1] - m) / s), rtol=1e-7)


def test_identifiability(spark, rows):
    """An effort that nearly is one of the features can't be told from it: the interval widens and the condition number says so."""
    near = rows.withColumns({"effort": F.col("o"), "twin": F.col("o") + 0.01 * F.col("a")})
    alone, beside = glm.identifiability(near, spark, ["twin"], "y", "effort").collect()
    assert alone.condition < 100 < beside.condition and beside.high - beside.low > 10 * (alone.high - alone.low)
    assert alone.low < alone.exponent < alone.high
    with pytest.raises(ValueError, match="told apart"):
        glm.poisson(rows.withColumn("same", F.col("a") * 2), ["a", "same"], "y", "o")


def test_nulls_constants_and_repeats(rows):
    holes = rows.withColumns({"a": F.when(F.col("fold") != 0, F.col("a")), "one": F.lit(7.0)})
    fit = glm.poisson(holes, ["a", "one"], "y", "o", 0.1, True)[None]
    x, y, o, fold = arrays(rows)
    assert fit.rows == (fold != 0).sum() and fit.coef[2] == 0 and fit.scale[1] == 1
    twice = glm.poisson(rows.unionByName(rows), ["a"], "y", "o")[None]
    once = glm.poisson(rows, ["a"], "y", "o")[None]
    assert np.allclose(twice.coef, once.coef) and np.allclose(2 * twice.covariance, once.covariance)
