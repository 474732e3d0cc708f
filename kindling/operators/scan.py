"""States that depend on the state before, over series of any length, where steps compose: a day's step is a map, and a run of
days is one map of the same kind.

Rows are numbered over range partitions. CHUNK maps compose to one, CHUNK of those to one, and so on up to one for each key; then states
follow downwards, each chunk from the state before it. So a series of any length is split over tasks, without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.operators.ranks import ranked
from kindling.operators.shared import cut

CHUNK = 64


def scanned(df: DataFrame, keys: list[str], order: list[Column], step: Column, start: Column, compose: Callable, apply: Callable, name: str) -> DataFrame:
    """df with the state after each row, by `order`, which tells all rows of a key apart; keys aren't null.

    `step` is the map of a row; compose(f, g) is the map of f, then g; apply(f, state) is the state after it.
    """
    rows = cut(ranked(df.withColumn("_f", step), keys, order, "_seq").withColumn("_seq", F.col("_seq") - 1))
    most = rows.agg(F.max("_seq")).first()[0]
    if most is None:
        return rows.drop("_f", "_seq").withColumn(name, start)
    levels, nodes = [], rows.select(*keys, "_seq", "_f")
    while True:
        own = nodes.groupBy(*keys, F.expr(f"_seq div {CHUNK}").alias("_seq")).agg(F.sort_array(F.collect_list(F.struct("_seq", "_f"))).alias("_run"))  # CHUNK at most
        whole = F.aggregate(F.slice("_run", F.lit(2), F.lit(CHUNK)), F.get("_run", F.lit(0))["_f"], lambda f, r: compose(f, r["_f"]))
        levels.append(cut(own.withColumn("_f", whole)))
        nodes, most = levels[-1].select(*keys, "_seq", "_f"), most // CHUNK
        if most == 0:
            break
    before = nodes.select(*keys, "_seq", start.alias("_s"))
    for i, level in enumerate(reversed(levels)):
        last = i == len(levels) - 1  # its runs are rows, whose states after them are asked for
        empty = F.transform(F.slice("_run", F.lit(1), F.lit(0)), lambda r: F.struct(r["_seq"].alias("_seq"), F.col("_s").alias("_s")))

        def along(a, r):
            now = apply(r["_f"], a["now"])
            return F.struct(now.alias("now"), F.array_append(a["out"], F.struct(r["_seq"].alias("_seq"), (now if last else a["now"]).alias("_s"))).alias("out"))

        met = level.join(before, [*keys, "_seq"]).select(*keys, F.explode(F.aggregate("_run", F.struct(F.col("_s").alias("now"), empty.alias("out")), along)["out"]).alias("_r"))
        before = met.select(*keys, F.col("_r._seq").alias("_seq"), F.col("_r._s").alias("_s"))
    return rows.join(before, [*keys, "_seq"]).select(*df.columns, F.col("_s").alias(name))


def clamped(a: Column, b: Column, low: Column, high: Column) -> Column:
    """The map x -> a * x + b, no less than low and no more than high; a isn't negative."""
    return F.struct(*(v.cast("double").alias(n) for n, v in (("a", a), ("b", b), ("low", low), ("high", high))))


def clamp(f: Column, x: Column) -> Column:
    return F.least(f["high"], F.greatest(f["low"], f["a"] * x + f["b"]))


def clamp_both(f: Column, g: Column) -> Column:
    """f, then g: maps of this kind compose to one of their kind."""
    return clamped(f["a"] * g["a"], f["b"] * g["a"] + g["b"], clamp(g, f["low"]), clamp(g, f["high"]))


def drought(annual_mm: float, temp_c: Column, rain_mm: Column, gate: bool = True) -> Column:
    """A day of the Keetch-Byram index in hundredths of an inch as a clamped map: rain above a fifth of an inch wets, warm days dry a share of what is left to 800."""
    import math

    # Of the published index.
    scale = 1.0 + 10.88 * math.exp(-0.0441 * annual_mm / 25.4)
    hot = temp_c * 9.0 / 5.0 + 32.0
    share = F.greatest(F.lit(0.0), (0.968 * F.exp(0.0486 * hot) - 8.30) * 1e-3 / scale)
    share = F.when(hot > 50.0, share).otherwise(0.0) if gate else share
    wet = F.greatest(F.lit(0.0), rain_mm / 25.4 - 0.2) * 100.0
    keep = F.greatest(F.lit(0.0), 1.0 - share)
    return clamped(keep, 800.0 * (1.0 - keep) - keep * wet, 800.0 * (1.0 - keep), F.lit(800.0))
