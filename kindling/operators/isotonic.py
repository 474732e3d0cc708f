"""Isotonic fits over any number of rows, their knots, and thresholds chosen on calibrated scores.

Pooling adjacent violators is the lower hull of running sums, and the hull of hulls is the hull: ranges of scores are pooled apart, then
four neighbouring ranges at a time, until means rise over every border. Only blocks move after the first round. Labels of 0 and 1 over n
rows have O(n ** (2/3)) blocks at most, as their means are distinct fractions whose denominators sum to n.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.operators.shared import cut

#: Ranges that meet in a round.
FAN = 4


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low", kind="stable")
    stack: list[list] = []
    for low, high, total, weight in zip(rows.low.tolist(), rows.high.tolist(), rows.total.tolist(), rows.weight.tolist()):
        while stack and stack[-1][2] * weight >= total * stack[-1][3]:
            low, _, t, w = stack.pop()
            total, weight = total + t, weight + w
        stack.append([low, high, total, weight])
    out = rows.iloc[: len(stack)].copy()
    for i, name in enumerate(("low", "high", "total", "weight")):
        out[name] = [b[i] for b in stack]
    return out


def blocks(df: DataFrame, keys: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Blocks of the non-decreasing fit per key: keys, low and high (the block's first and last score), total, weight, mean. Means rise strictly.

    Rows without score, label or weight, and weights of 0 or less, don't count. Equal scores are one level, so the order of rows doesn't matter.
    Keys may be null. A table without rows has no blocks.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("_y"), w.alias("_w")).where("low is not null and not isnan(low) and _y is not null and not isnan(_y) and _w > 0")
    levels = rows.groupBy(*keys, "low").agg(F.sum(F.col("_y") * F.col("_w")).alias("total"), F.sum("_w").alias("weight"))
    x = levels.repartitionByRange(*keys, "low").select(*keys, "low", F.col("low").alias("high"), "total", "weight", F.spark_partition_id().alias("part"))
    x, order = cut(x), Window.partitionBy(*keys).orderBy("part")
    mean = F.col("total") / F.col("weight")
    while True:
        x = cut(x.groupBy(*keys, "part").applyInPandas(_pool, x.schema))
        ends = x.groupBy(*keys, "part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))  # a row for each range
        if ends.withColumn("before", F.lag("last").over(order)).where("before >= first").isEmpty():
            return x.select(*keys, "low", "high", "total", "weight", mean.alias("mean"))
        x = x.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))


def knots(fit: DataFrame, keys: list[str], most: int = 60, steps: int = 200) -> DataFrame:
    """The fit as `most` knots or fewer per key: keys, place from 1, x, y.

    Between blocks the fit is a line, outside of them flat. It is read at `steps` + 1 even places from 0 to 1; the places where it bends stay,
    thinned evenly where there are more than `most`. Blocks are summed up by place first, so a key never has more than steps + 1 rows in a task.
    """
    ends = fit.select(*keys, F.explode(F.array(F.struct(F.col("low").alias("x"), "mean"), F.struct(F.col("high").alias("x"), "mean"))).alias("at"))
    scaled = F.round(F.col("at.x") * steps, 9)
    none = F.lit(None).cast("struct<x:double,mean:double>")
    low = ends.select(*keys, F.greatest(F.ceil(scaled), F.lit(0)).alias("_k"), F.col("at").alias("_b"), none.alias("_a"))
    high = ends.select(*keys, F.least(F.floor(scaled), F.lit(steps)).alias("_k"), none.alias("_b"), F.col("at").alias("_a"))
    grid = fit.select(*keys).distinct() if keys else fit.agg(F.count("*").alias("_n")).where("_n > 0").drop("_n")
    grid = grid.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("_k"), none.alias("_b"), none.alias("_a"))
    cells = low.unionByName(high).unionByName(grid).where((F.col("_k") >= 0) & (F.col("_k") <= steps)).groupBy(*keys, "_k").agg(F.max("_b").alias("_b"), F.min("_a").alias("_a"))
    by = Window.partitionBy(*keys).orderBy("_k")
    b, a, g = F.last("_b", True).over(by), F.first("_a", True).over(by.rowsBetween(0, Window.unboundedFollowing)), F.col("_k") / float(steps)
    near = cells.select(*keys, "_k", g.alias("x"), b.alias("_b"), a.alias("_a"))
    line = F.col("_b.mean") + (F.col("_a.mean") - F.col("_b.mean")) * (F.col("x") - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x"))
    y = F.when(F.col("_b").isNull(), F.col("_a.mean")).when(F.col("_a").isNull() | (F.col("_a.x") <= F.col("_b.x")), F.col("_b.mean")).otherwise(line)
    curve = near.select(*keys, "_k", "x", y.alias("y"))
    bend = F.lead("y").over(by) - 2 * F.col("y") + F.lag("y").over(by)
    kept = curve.withColumn("_bend", bend).where("_bend is null or abs(_bend) > 1e-9")
    kept = kept.withColumns({"_p": F.row_number().over(by) - 1, "_n": F.count("*").over(Window.partitionBy(*keys)) - 1})
    nearest = F.round(F.round(F.col("_p") * (most - 1) / F.col("_n")) * F.col("_n") / (most - 1))
    kept = kept.where((F.col("_n") < most) | (nearest == F.col("_p")))
    return kept.select(*keys, F.row_number().over(by).alias("place"), F.round("x", 4).alias("x"), F.round(F.max("y").over(by), 5).alias("y"))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def interpolated(x: Column, curve: Column) -> Column:
    """The value at x of a curve, an array of structs (x, y) in rising order; flat outside of it, null for a null x or an empty curve."""
    n = F.size(curve)

    def at(x: Column, i: Column) -> Column:
        a, b = F.get(curve, i - 1), F.get(curve, i)
        line = (b["y"] - a["y"]) / (b["x"] - a["x"]) * (x - a["x"]) + a["y"]
        return F.when(x.isNull(), F.lit(None)).when(i == 0, F.get(curve, F.lit(0))["y"]).when(i == n, F.get(curve, n - 1)["y"]).otherwise(line)

    return _let(x, lambda v: _let(F.size(F.filter(curve, lambda k: k["x"] <= v)), lambda i: at(v, i)))


def best_thresholds(df: DataFrame, keys: list[str], score: str, label: str, default: float = 0.5, least: int = 20, bias: tuple[float, float] = (0.8, 1.25)) -> DataFrame:
    """Per key the threshold from 0.05 to 0.95 with the best critical success index among those whose frequency bias lies within `bias`.

    A later threshold must beat the index of an earlier one as rounded. Keys with fewer than `least` events, or none within the bounds, keep `default`.
    """
    taus = [round(0.05 * i, 2) for i in range(1, 20)]
    above = _let(F.col(score), lambda s: F.size(F.filter(F.array(*map(F.lit, taus)), lambda t: t <= s)))
    bins = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, above.alias("bin")).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("n"))
    per = [F.struct(F.lit(t).alias("tau"), F.sum(F.when(F.col("bin") > i, F.col("hits")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("bin") > i, F.col("n")).otherwise(0)).alias("alarms")) for i, t in enumerate(taus)]
    x = bins.groupBy(*keys).agg(F.array(*per).alias("t"), F.sum("hits").alias("events"), F.sum("n").alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("csi"), F.lit(None).cast("double").alias("bias"))

    def better(best: Column, t: Column) -> Column:
        csi, ratio = F.try_divide(t["hits"], t["alarms"] + F.col("events") - t["hits"]), t["alarms"] / F.col("events")
        wins = ratio.between(*bias) & (best["csi"].isNull() | (csi > best["csi"]))
        return F.when(wins, F.struct(t["tau"].alias("threshold"), F.bround(csi, 4).alias("csi"), F.bround(ratio, 4).alias("bias"))).otherwise(best)

    x = x.withColumn("best", F.when(F.col("events") >= least, F.aggregate("t", start, better)).otherwise(start))
    source = F.when(F.col("events") < least, "too few events").when(F.col("best.threshold").isNull(), "none within bounds").otherwise("fitted")
    return x.select(*keys, "rows", "events", F.coalesce("best.threshold", F.lit(default)).alias("threshold"), "best.csi", "best.bias", source.alias("source"))


def calibrated(df: DataFrame, keys: list[str], score: str, label: str, least: int = 20, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(df with `calibrated`, a row per key with events, rows and status): keys with fewer than `least` of either outcome keep their scores.

    Curves are joined by key: `most` knots each. Where keys are more than broadcast allows, Spark shuffles them.
    """
    seen = F.col(score).isNotNull() & F.col(label).isNotNull()
    support = cut(df.groupBy(*keys).agg(F.count_if(seen & (F.col(label) > 0)).alias("events"), F.count_if(seen).alias("rows")))
    ok = (F.col("events") >= least) & (F.col("rows") - F.col("events") >= least)
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    fit = df.alias("a").join(support.where(ok).alias("b"), same("a", "b"), "left_semi")
    curves = knots(blocks(fit, keys, score, label), keys, most)
    curves = cut(curves.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_curve")))  # `most` knots
    out = df.alias("a").join(curves.alias("b"), same("a", "b"), "left")
    value = F.when(F.col("_curve").isNull(), F.col(score).cast("double")).otherwise(interpolated(F.col(score).cast("double"), F.col("_curve")))
    status = F.when(ok, "fitted").otherwise("identity")
    return out.select(*(F.col(f"a.{c}") for c in df.columns), value.alias("calibrated")), support.select(*keys, "events", "rows", status.alias("status"))
