"""Fuel models, severity within a class, greenness and version strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindling.functions import weather as w
from kindling.functions.scores import ramp
from kindling.functions.weather import clip

# Relative spread and intensity of the forty fuel models, by code
FUEL_MODELS = {
    "NB1": (0.0, 0.0), "NB2": (0.0, 0.0), "NB3": (0.0, 0.0), "NB8": (0.0, 0.0), "NB9": (0.0, 0.0),
    "GR1": (3.0, 1.0), "GR2": (3.0, 2.0), "GR3": (3.0, 2.0), "GR4": (4.0, 2.0), "GR5": (3.0, 2.0), "GR6": (4.0, 3.0), "GR7": (4.0, 3.0), "GR8": (4.0, 4.0), "GR9": (4.0, 4.0),
    "GS1": (2.0, 2.0), "GS2": (3.0, 2.0), "GS3": (3.0, 3.0), "GS4": (3.0, 4.0),
    "SH1": (1.0, 1.0), "SH2": (2.0, 2.0), "SH3": (2.0, 2.0), "SH4": (2.0, 3.0), "SH5": (4.0, 4.0), "SH6": (3.0, 3.0), "SH7": (3.0, 4.0), "SH8": (3.0, 3.0), "SH9": (3.0, 4.0),
    "TU1": (1.0, 1.0), "TU2": (1.0, 2.0), "TU3": (2.0, 2.0), "TU4": (2.0, 3.0), "TU5": (2.0, 3.0),
    "TL1": (1.0, 1.0), "TL2": (1.0, 1.0), "TL3": (1.0, 1.0), "TL4": (1.0, 2.0), "TL5": (1.0, 2.0), "TL6": (2.0, 2.0), "TL7": (1.0, 2.0), "TL8": (2.0, 2.0), "TL9": (2.0, 3.0),
    "SB1": (1.0, 2.0), "SB2": (2.0, 3.0), "SB3": (2.0, 4.0), "SB4": (3.0, 4.0),
}
# Cap and weight of the slope, sheltering by canopy, weight and power of the wind
SLOPE_CAP, SLOPE_K, CANOPY_MOST, WIND_K, WIND_POWER = 45.0, 6.0, 0.85, 0.06, 1.5
# Degree-days at which greening begins and ends, and live moisture (herbs, wood) cured and green
GREEN_FROM, GREEN_TO, HERBS, WOOD = 200.0, 1000.0, (60.0, 120.0), (90.0, 150.0)


def fuel_index(code: Column, slope: Column, wind_kts: Column, canopy: Column, kind: int) -> Column:
    """Relative spread (kind 0) or intensity (1) of a fuel model under slope and sheltered wind; null for an unknown code, 0 if it doesn't burn."""
    base = F.try_element_at(F.create_map(*(F.lit(x) for c, v in FUEL_MODELS.items() for x in (c, v[kind]))), code)
    tan = F.tan(F.radians(clip(slope, 0.0, SLOPE_CAP)))
    sheltered = F.greatest(wind_kts, F.lit(0.0)) * (1.0 - CANOPY_MOST * clip(canopy, 0.0, 100.0) / 100.0)
    return F.when(base == 0, 0.0).otherwise(base * (1.0 + SLOPE_K * tan * tan) * (1.0 + WIND_K * F.pow(sheltered, WIND_POWER)))


def fuel_group(code: Column) -> Column:
    """grass, shrub, timber, nonburnable or unknown, of a numeric fuel model."""
    n = F.bround(code, 0).cast("int")
    return (
        F.when(n.isin(0, 91, 93, 98, 99), "nonburnable").when(n.between(101, 124) | n.between(1, 3), "grass").when(n.between(141, 149) | n.between(4, 7), "shrub")
        .when(n.between(161, 204) | n.between(8, 13), "timber").otherwise("unknown")
    )


#: How far a class reaches, as value at its edge and value from where it counts in full, for each of three variables.
WIND_EDGE = min(w.ELEVATED_WIND, w.VERY_DRY_WIND)
EXTREME_WIND_SPAN = 15.0
DEPTHS = {
    2: {"rh": (w.ELEVATED_RH, w.CRITICAL_RH), "wind": (WIND_EDGE, w.CRITICAL_WIND), "fm": (w.ELEVATED_FM, 0.0)},
    3: {"rh": (w.CRITICAL_RH, w.EXTREME_RH), "wind": (w.CRITICAL_WIND, w.EXTREME_WIND), "fm": (w.ELEVATED_FM, w.EXTREME_FM)},
    4: {"rh": (w.EXTREME_RH, 0.0), "wind": (w.EXTREME_WIND, w.EXTREME_WIND + EXTREME_WIND_SPAN), "fm": (w.EXTREME_FM, 0.0)},
}


def severity(category: Column, fm: Column, rh: Column, wind: Column) -> Column:
    """How far into its class a value of elevated, critical or extreme danger lies, 0 to 1: the mean depth of its variables; 1 for the other classes."""
    values, out = {"rh": rh, "wind": wind, "fm": fm}, F.lit(1.0)
    for level, reach in DEPTHS.items():
        depths = [ramp(values[name], *edges) for name, edges in reach.items()]
        out = F.when(category == level, sum(depths[1:], depths[0]) / len(depths)).otherwise(out)
    return out


def demoted(category: Column, share: Column, green: Column, most: float) -> Column:
    """One class down where a value is elevated or worse, but lies less deep in its class than the green share allows."""
    return F.when((category >= 2) & (green > 0) & (share < green * most), category - 1).otherwise(category).cast("int")


def greenness(gdd: Column) -> Column:
    return clip((gdd - GREEN_FROM) / (GREEN_TO - GREEN_FROM), 0.0, 1.0)


def live_moisture(gdd: Column, ends: tuple[float, float]) -> Column:
    return ends[0] + greenness(gdd) * (ends[1] - ends[0])


def anchored(member: Column, control: Column, production: Column, low: float, high: float) -> Column:
    """Production moved by what sets a member apart from the control; the member itself where either is missing."""
    return clip(F.coalesce(production + (member - control), member), low, high)


def alert_level(fm: Column, rh: Column, wind_ms: Column) -> Column:
    """The prediction report's variant: any one of three limits raises the level; wind in mph."""
    mph = wind_ms * 2.237
    return F.when((fm < 5) | (rh < 20) | (mph > 25), 4).when((fm <= 7) | (rh <= 30) | (mph > 20), 3).when((fm <= 10) | (rh <= 35) | (mph > 15), 2).when((fm <= 15) | (rh <= 45) | (mph > 10), 1).otherwise(0)


def version(text: Column) -> Column:
    """major, minor, patch and beta (null without one) of a version string; null if it is none."""
    found = lambda i: F.nullif(F.regexp_extract(text, r"^(\d+)\.(\d+)\.(\d+)(?:-beta\.(\d+))?$", i), F.lit("")).cast("int")
    return F.struct(*(found(i + 1).alias(n) for i, n in enumerate(("major", "minor", "patch", "beta"))))


def next_version(stable: Column, bump: str, beta: Column | None = None) -> Column:
    """The version after `stable` (0.0.0 if null); with `beta`, the beta before or an empty text, the next beta of it."""
    v = version(F.coalesce(stable, F.lit("0.0.0")))
    parts = {"major": (v["major"] + 1, F.lit(0), F.lit(0)), "minor": (v["major"], v["minor"] + 1, F.lit(0)), "patch": (v["major"], v["minor"], v["patch"] + 1)}[bump]
    base = F.concat_ws(".", *(p.cast("string") for p in parts))
    if beta is None:
        return base
    again = F.when(F.startswith(beta, F.concat(base, F.lit("-beta."))), version(beta)["beta"]).otherwise(0)
    return F.concat(base, F.lit("-beta."), (F.coalesce(again, F.lit(0)) + 1).cast("string"))
