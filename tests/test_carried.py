"""Values carried over the borders of ranges, against a loop."""

import pytest
from pyspark.sql import functions as F

from kindling.operators import ranks


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_carried_against_a_loop(spark, own, keys):
    rows = [(("a", None, "b")[i % 3], i, float(i) if i % 11 == 4 else None, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v double, part string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: (r.filled, r.last and r.last[0]) for r in ranks.carried(df, keys, ["i"], {"filled": F.col("v"), "last": F.struct("i")}, own).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held, want = {}, {}
    for k, i, v, _ in rows:
        group = k if keys else 0
        now = (v if v is not None else held.get(group, (None, None))[0], i)
        want[i] = now if own else held.get(group, (None, None))
        held[group] = now
    assert got == want and len(got) == 200


def test_carried_over_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "i int, v double")
    assert [r.f for r in ranks.carried(df, [], ["i"], {"f": F.col("v")}).collect()] == [None, None]
    assert ranks.carried(df.where("false"), [], ["i"], {"f": F.col("v")}).count() == 0
