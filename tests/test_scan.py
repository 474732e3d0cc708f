"""Prefixes of composed maps against a loop, over several levels of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from kindling.operators import folds, scan


def scanned(rows, keys=("k",), gate=True):
    return scan.scanned(rows, [*keys], [F.col("d")], scan.drought(1000.0, F.col("t"), F.col("p"), gate), F.lit(0.0), scan.clamp_both, scan.clamp, "x")


@pytest.mark.parametrize("gate", [True, False])
def test_drought_of_short_and_long_series(spark, gate):
    """A series of three levels beside short ones: the values of a step after another, hot, cold, wet and dry."""
    draw, step = random.Random(8), folds.drought(1000.0, gate)
    rows = [(k, d, draw.choice([draw.uniform(-10, 45), 70.0]), draw.choice([0.0, 0.0, draw.uniform(0, 90)])) for k, n in ((1, scan.CHUNK**2 + 900), (2, 1), (3, 64), (4, 65)) for d in range(n)]
    want = {}
    for k in (1, 2, 3, 4):
        state = (0.0,)
        for _, d, t, p in (r for r in rows if r[0] == k):
            state = want[k, d] = step(state, t, p)
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "k int, d int, t double, p double").repartition(6)
    got = {(r.k, r.d): r.x for r in scanned(df, gate=gate).collect()}
    assert len(got) == len(rows) and all(got[i] == pytest.approx(want[i][0], abs=1e-7) for i in want)


def test_no_rows(spark):
    out = scanned(spark.createDataFrame([], "k int, d int, t double, p double"))
    assert out.columns == ["k", "d", "t", "p", "x"] and out.count() == 0


def test_composed_maps_are_the_maps_in_turn(spark):
    draw = random.Random(1)
    one = lambda: [draw.uniform(0, 2), draw.uniform(-50, 50), *sorted(draw.uniform(-100, 100) for _ in range(2))]
    df = spark.createDataFrame([(*one(), *one(), draw.uniform(-200, 200)) for _ in range(300)], [*"abcdefgh", "x"])
    f, g = scan.clamped(*map(F.col, "abcd")), scan.clamped(*map(F.col, "efgh"))
    far = F.abs(scan.clamp(scan.clamp_both(f, g), F.col("x")) - scan.clamp(g, scan.clamp(f, F.col("x"))))
    assert df.select(f.alias("f"), g.alias("g"), "x").agg(F.count("*")).first()[0] == 300
    assert df.agg(F.max(far)).first()[0] < 1e-9
