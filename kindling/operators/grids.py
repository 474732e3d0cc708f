"""Grids as long tables of (row, col, value): neighbourhoods are joins on shifted cells."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kernel(radius: int, weight) -> list[tuple[int, int, float]]:
    """Offsets (dy, dx, w) of a square of 2 * radius + 1 with a weight above 0."""
    reach = range(-radius, radius + 1)
    return [(y, x, w) for y in reach for x in reach if (w := weight(y, x)) > 0]


def disk(radius: int) -> list[tuple[int, int, float]]:
    return kernel(radius, lambda y, x: float(y * y + x * x <= radius * radius))


def around(grid: DataFrame, offsets: list[tuple[int, int, float]], keys: list[str]) -> DataFrame:
    """Each cell beside the values that an offset leads to: keys, row, col, w and value of the source.

    Every source cell is sent to the cells that look at it, so the join is on equality and
    grows with cells times offsets. Cells outside the grid don't exist.
    """
    shifts = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w")) for y, x, w in offsets))
    sent = grid.select(*keys, "row", "col", "value", F.explode(shifts).alias("o"))
    return sent.select(*keys, (F.col("row") - F.col("o.y")).alias("row"), (F.col("col") - F.col("o.x")).alias("col"), F.col("o.w").alias("w"), "value")


def neighbourhood_max(grid: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    best = around(grid, disk(radius), keys).groupBy(*keys, "row", "col").agg(F.max("value").alias("nbhd_max"))
    return grid.join(best, [*keys, "row", "col"], "left")


def _passes(cells: DataFrame, sigma: float, reach: int, keys: list[str], shape: tuple[int, int] | None = None) -> DataFrame:
    """keys, row, col, and smoothed: the Gaussian mean of the cells with a value, over a square of 2 * reach + 1; mirrored at the edges of a shape. An infinite sigma gives the plain mean.

    A Gaussian is a product, so sums and weights go along one axis and then the other: 2 * reach + 1 rows a cell each time instead of their square.
    """
    x = cells.where("value is not null").select(*keys, "row", "col", F.col("value").alias("_s"), F.lit(1.0).alias("_w"))
    for i, axis in enumerate(("row", "col")):
        to, n = F.col(axis), shape and shape[i]
        sent = []
        for o in range(-reach, reach + 1):
            w = F.lit(math.exp(-o * o / (2 * sigma * sigma))).alias("w")
            for at in (to - o, *((-1 - to - o, 2 * n - 1 - to - o) if n else ())):  # the place itself and its images behind both edges
                sent.append(F.struct(at.cast("int").alias("at"), w))
        sent = F.array(*sent)
        if n:
            sent = F.filter(sent, lambda t: (t["at"] >= 0) & (t["at"] < n))
        rest = [*keys, "col" if axis == "row" else "row"]
        x = x.select(*rest, "_s", "_w", F.explode(sent).alias("_t")).groupBy(*rest, F.col("_t.at").alias(axis)).agg(F.sum(F.col("_t.w") * F.col("_s")).alias("_s"), F.sum(F.col("_t.w") * F.col("_w")).alias("_w"))
    return x.select(*keys, "row", "col", F.try_divide("_s", "_w").alias("smoothed"))


def gaussian(grid: DataFrame, sigma: float, reach: int, keys: list[str]) -> DataFrame:
    """Smoothed over the cells that have a value; cells without any in reach stay null."""
    return grid.join(_passes(grid, sigma, reach, keys), [*keys, "row", "col"], "left")


def antecedent(grid: DataFrame, day: str, days: int, keys: list[str]) -> DataFrame:
    """Sum of each cell's value over the `days` days before."""
    past = grid.select(*keys, "row", "col", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_d"), F.col(day).alias("_at"), F.col("value").alias("_v"))
    past = past.groupBy(*keys, "row", "col", (F.col("_at") + F.col("_d")).alias(day)).agg(F.sum("_v").alias("antecedent"))
    return grid.join(past, [*keys, "row", "col", day], "left").na.fill(0.0, ["antecedent"])


def smoothed(grid: DataFrame, sigma: float, shape: tuple[int, int], keys: list[str], fill_mean: bool = False) -> DataFrame:
    """grid with `smoothed`: a Gaussian cut at four sigma over mirrored edges; shape is at least that far.

    Cells without a value take no part, or with `fill_mean` the mean of their grid; in that case they stay null themselves.
    """
    own = grid
    if fill_mean:
        means = grid.groupBy(*keys).agg(F.avg("value").alias("_m"))
        own = grid.join(means, keys).withColumn("value", F.coalesce("value", "_m")).drop("_m")
    out = grid.join(_passes(own, sigma, int(4 * sigma + 0.5), keys, shape), [*keys, "row", "col"], "left")
    return out.withColumn("smoothed", F.when(F.col("value").isNotNull(), F.col("smoothed"))) if fill_mean else out


def triangle_weights(points: DataFrame) -> DataFrame:
    """dst, row, col and w: the corners of the triangle that holds each point (dst, y, x) on a grid of unit cells, each cut along its rising diagonal."""
    y0, x0 = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - y0, F.col("x") - x0
    corner = lambda dy, dx, w: F.struct((y0 + dy).cast("int").alias("row"), (x0 + dx).cast("int").alias("col"), w.alias("w"))
    low = F.array(corner(0, 0, 1 - fx), corner(0, 1, fx - fy), corner(1, 1, fy))
    high = F.array(corner(0, 0, 1 - fy), corner(1, 0, fy - fx), corner(1, 1, fx))
    return points.select("dst", F.explode(F.when(fx >= fy, low).otherwise(high)).alias("c")).select("dst", "c.*").where("w > 0")


def regridded(grid: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dst and value at each target; null where a corner with weight is null or outside."""
    need = weights.groupBy("dst").agg(F.count("*").alias("_n"))
    met = grid.where("value is not null").join(weights, ["row", "col"]).groupBy(*keys, "dst").agg(F.sum(F.col("w") * F.col("value")).alias("v"), F.count("*").alias("_got"))
    all_targets = grid.select(*keys).distinct().join(F.broadcast(need))  # the targets of one grid, for each key
    return all_targets.join(met, [*keys, "dst"], "left").select(*keys, "dst", F.when(F.col("_got") == F.col("_n"), F.col("v")).alias("value"))


def cropped(grid: DataFrame, mask: Column, keys: list[str]) -> DataFrame:
    """The rows and columns between the first and last cells that `mask` holds for."""
    box = grid.where(mask).groupBy(*keys).agg(*(f(c).alias(f"_{n}{c}") for c in ("row", "col") for n, f in (("a", F.min), ("b", F.max))))
    return grid.join(box, keys).where("row between _arow and _brow and col between _acol and _bcol").select(*grid.columns)


def terrain(grid: DataFrame, dy: float, dx: float, keys: list[str]) -> DataFrame:
    """slope and aspect of each cell: central differences inside, one-sided at the edges."""

    def slope_of(axis: str, other: str, step: float) -> Column:
        by = Window.partitionBy(*keys, other).orderBy(axis)
        a, b, v = F.lag("value").over(by), F.lead("value").over(by), F.col("value")
        return F.when(a.isNull(), (b - v) / step).when(b.isNull(), (v - a) / step).otherwise((b - a) / (2 * step))

    g = grid.withColumn("_dy", slope_of("row", "col", dy)).withColumn("_dx", slope_of("col", "row", dx))
    return g.withColumns({"slope": F.degrees(F.atan(F.hypot("_dx", "_dy"))), "aspect": F.atan2(-F.col("_dx"), F.col("_dy"))}).drop("_dy", "_dx")


def ruggedness(grid: DataFrame, shape: tuple[int, int], keys: list[str]) -> DataFrame:
    """grid with ruggedness, the spread of the three by three cells around each, over mirrored edges; null where the cell has no value.

    Neighbours without a value take no part. Values are taken from their grid's mean first, so that high, even ground loses no digits.
    """
    means = grid.groupBy(*keys).agg(F.avg("value").alias("_m"))
    own = grid.join(means, keys).withColumn("value", F.col("value") - F.col("_m")).select(*keys, "row", "col", "value")
    one = _passes(own, math.inf, 1, keys, shape)
    two = _passes(own.withColumn("value", F.col("value") * F.col("value")), math.inf, 1, keys, shape).withColumnRenamed("smoothed", "_two")
    spread = one.join(two, [*keys, "row", "col"]).select(*keys, "row", "col", F.sqrt(F.greatest(F.col("_two") - F.col("smoothed") * F.col("smoothed"), F.lit(0.0))).alias("ruggedness"))
    return grid.join(spread, [*keys, "row", "col"], "left").withColumn("ruggedness", F.when(F.col("value").isNotNull(), F.col("ruggedness")))


def complete_sequences(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """keys and `steps`, the values in order, of groups as long as most are (the longer of equal) and without a null."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(reduce(or_, (F.col(v).isNull() for v in values))).alias("_void"))
    usual = sizes.groupBy("_n").agg(F.count("*").alias("_c")).agg(F.max(F.struct("_c", "_n"))["_n"].alias("_usual"))
    good = sizes.join(F.broadcast(usual)).where("_n = _usual and _void = 0").select(*keys)  # one row
    return df.join(good, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *values))).alias("steps"))
