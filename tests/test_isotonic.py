"""The pooled fit against the max-min form and one stack over all levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import isotonic


def brute(p, y):
    """max over starts of the min over ends of the mean in between, at each distinct score."""
    xs = np.unique(p)
    s, w = np.array([y[p == x].sum() for x in xs]), np.array([(p == x).sum() for x in xs])
    mean = lambda a, b: s[a : b + 1].sum() / w[a : b + 1].sum()
    return xs, np.array([max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))])


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "late"])
def test_blocks_are_the_isotonic_fit(spark, shape):
    r = np.random.default_rng(3)
    p = r.integers(0, 60, 800) / 60
    chance = {"noise": 0.3 + 0 * p, "rising": p, "falling": 1 - p, "late": np.where(p > 0.95, 0.0, p)}[shape]
    y = (r.random(800) < chance).astype(int)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fit = isotonic.blocks(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int"), [], "p", "y").orderBy("low").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    xs, want = brute(p, y)
    got = np.array([fit[(fit.low <= x) & (fit.high >= x)]["mean"].item() for x in xs])
    assert np.allclose(got, want, atol=1e-12)
    assert (np.diff(fit["mean"]) > 0).all() and fit.weight.sum() == 800


def test_awkward_rows(spark):
    schema = "k string, p double, y int, w double"
    rows = [(None, 0.5, 1, 1.0), (None, 0.5, 0, 3.0), ("a", None, 1, 1.0), ("a", 0.2, None, 1.0), ("a", float("nan"), 1, 1.0), ("a", 0.3, 1, 0.0), ("a", 0.4, 0, 2.0)]
    df = spark.createDataFrame(rows, schema)
    got = {r.k: (r.low, r.high, r["mean"], r.weight) for r in isotonic.blocks(df, ["k"], "p", "y", "w").collect()}
    assert got == {None: (0.5, 0.5, 0.25, 4.0), "a": (0.4, 0.4, 0.0, 2.0)}
    none = isotonic.blocks(df.where("false"), ["k"], "p", "y")
    assert none.count() == 0 and isotonic.knots(none, ["k"]).count() == 0 and isotonic.knots(isotonic.blocks(df.where("false"), [], "p", "y"), []).count() == 0


def test_knots_follow_the_fit(spark):
    r = np.random.default_rng(5)
    p = r.random(5000)
    y = (r.random(5000) < p**2).astype(int)
    fit = isotonic.blocks(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int"), [], "p", "y")
    k, b = isotonic.knots(fit, []).toPandas(), fit.orderBy("low").toPandas()
    assert len(k) <= 60 and (np.diff(k.x) > 0).all() and (np.diff(k.y) >= 0).all() and k.x.iloc[0] == 0 and k.x.iloc[-1] == 1
    ends = np.column_stack([b.low, b.high]).ravel()
    grid = np.interp(np.linspace(0, 1, 201), ends, np.repeat(b["mean"], 2))
    at = np.round(k.x * 200).astype(int)
    assert np.allclose(k.y, grid[at], atol=6e-6)
    assert isotonic.knots(fit, [], most=7).count() == 7


def test_interpolated_and_identity(spark):
    curve = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 0.1), (0.4, 0.5), (0.8, 0.6))))
    xs = [None, 0.0, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(isotonic.interpolated(F.col("x"), curve)).collect()]
    assert got[0] is None and np.allclose(got[1:], np.interp(xs[1:], [0.2, 0.4, 0.8], [0.1, 0.5, 0.6]))
    few = spark.createDataFrame([("a", i / 50, int(i > 40)) for i in range(50)] + [("b", i / 50, int(i > 20)) for i in range(50)], "k string, p double, y int")
    rows, support = isotonic.calibrated(few, ["k"], "p", "y")
    assert {r.k: r.status for r in support.collect()} == {"a": "identity", "b": "fitted"}
    assert rows.where("k = 'a' and calibrated <> p").count() == 0 and rows.where("k = 'b' and abs(calibrated - y) > 1e-9").count() <= 1
    best = {r.k: (r.threshold, r.source) for r in isotonic.best_thresholds(rows, ["k"], "calibrated", "y").collect()}
    assert best["a"] == (0.5, "too few events") and best["b"][1] == "fitted"
