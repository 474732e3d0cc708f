"""Ramps, weighted scores, lookups and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindling.functions.weather import clip

# Factor ramps (benign, extreme), their weights, and the raw score at the ceiling
RAMPS = {"rh": (45.0, 20.0), "wind": (10.0, 25.0), "vpd": (1.0, 4.0), "kbdi": (0.0, 150.0), "cure": (200.0, 1200.0), "precip_relief": (0.0, 10.0)}
WEIGHTS = {"rh": 0.25, "wind": 0.25, "vpd": 0.20, "kbdi": 0.15, "cure": 0.10, "precip_relief": 0.05}
RELIEF_MM = {"grass": 5.0, "shrub": 10.0, "timber": 18.0, "nonburnable": 10.0, "unknown": 10.0}
CEILING = 0.6076826763957318


def ramp(x: Column, benign: float, extreme: float) -> Column:
    """0 at `benign`, 1 at `extreme`, linear between and flat beyond; null in, null out."""
    return clip((x - benign) / (extreme - benign), 0.0, 1.0)


def weighted_score(factors: dict[str, Column], weights: dict[str, float] = WEIGHTS, ceiling: float = CEILING) -> Column:
    """Mean of the factors present, weights renormalised over them; relief counts against. Null without any factor."""
    top = sum((F.coalesce((-w if n == "precip_relief" else w) * factors[n], F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
    below = sum((F.when(factors[n].isNotNull(), w).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    return F.when(below > 0, clip(F.try_divide(top, below) / ceiling, 0.0, 1.0))


def level(score: Column, edges: list[float]) -> Column:
    """How many of the rising edges the score reaches."""
    return F.when(score.isNotNull(), sum((F.when(score >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("int")


def bin_right(x: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the bin (a, b] that holds x; null outside."""
    out = F.when(x.isNull() | (x <= edges[0]), F.lit(None))
    for edge, name in zip(edges[1:], names):
        out = out.when(x <= edge, name)
    return out.cast("string")


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, flat outside them."""
    out = F.when(x.isNull(), F.lit(None)).when(x <= knots[0][0], knots[0][1])
    for (a, y), (b, z) in zip(knots, knots[1:]):
        if b > a:
            out = out.when(x <= b, y + (x - a) * ((z - y) / (b - a)))
    return out.otherwise(knots[-1][1]).cast("double")


def logit(p: Column, edge: float = 1e-6) -> Column:
    p = clip(p, edge, 1 - edge)
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def guarded_score(fm: Column, rh: Column, wind_mph: Column, rain: Column) -> Column:
    """Danger on 0 to 100. Classes overwrite each other's base, but the gradients of all classes that hold add up; rain takes off up to 20, not below 10."""
    kts = wind_mph * 0.868976
    part = lambda x: clip(x, 0.0, 1.0)
    classes = [
        (fm >= 15, 10.0, None),
        ((fm >= 10) & (fm < 15) & ((rh < 60) | (kts >= 6)), 30.0, (part((60 - rh) / 60) + part(kts / 15)) / 2 * 10),
        ((fm < 10) & ((rh < 45) | (kts >= 10)), 50.0, (part((45 - rh) / 45) + part(kts / 20)) / 2 * 10),
        ((fm < 10) & (rh < 25) & (kts >= 15), 70.0, (part((25 - rh) / 25) + part(kts / 30) + part((10 - fm) / 10)) / 3 * 10),
        ((fm < 7) & (rh < 20) & (kts >= 30), 90.0, (part((20 - rh) / 20) + part((kts - 30) / 20) + part((7 - fm) / 7)) / 3 * 10),
    ]
    base = F.lit(0.0)
    for holds, points, _ in classes:
        base = F.when(holds, points).otherwise(base)
    total = base + sum((F.when(h, g).otherwise(0.0) for h, _, g in classes if g is not None), F.lit(0.0))
    eased = F.when(rain > 0.1, F.greatest(total - clip(rain * 20, 0.0, 20.0), F.lit(10.0))).otherwise(total)
    return clip(eased, 0.0, 100.0)
