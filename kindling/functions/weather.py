"""Weather and fuel formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule thresholds (fuel moisture %, relative humidity %, wind in knots)
LOW_FM = 15.0
MODERATE_RH, MODERATE_WIND = 45.0, 10.0
ELEVATED_FM, ELEVATED_RH, ELEVATED_WIND = 9.0, 35.0, 12.0
VERY_DRY_RH, VERY_DRY_WIND = 25.0, 5.0
CRITICAL_RH, CRITICAL_WIND = 25.0, 15.0
EXTREME_FM, EXTREME_RH, EXTREME_WIND = 7.0, 20.0, 25.0
KNOTS_PER_MS = 1.9438444924406
EARTH_KM = 6371.0088


def clip(x: Column, low, high) -> Column:
    """x within [low, high]; null stays null, which greatest() and least() would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def equilibrium_moisture(temp_c: Column, rh: Column) -> Column:
    """Nelson's equilibrium fuel moisture in percent, within 1 to 40."""
    dry = 0.03 + 0.2626 * rh - 0.00104 * rh * temp_c
    middle = 2.22 - 0.160 * rh + 0.01660 * temp_c
    wet = 21.06 - 0.4944 * rh + 0.005565 * rh * rh - 0.00063 * rh * temp_c
    return clip(F.when(rh <= 10, dry).when(rh <= 50, middle).otherwise(wet), 1.0, 40.0)


def vapor_deficit_kpa(temp_c: Column, rh: Column) -> Column:
    full = 0.6108 * F.exp(17.27 * temp_c / (temp_c + 237.3))
    return F.greatest(F.lit(0.0), full - full * clip(rh, 0.0, 100.0) / 100.0)


def humidity(temp_c: Column, dew_c: Column) -> Column:
    """Relative humidity in percent from temperature and dew point."""
    magnus = lambda t: F.exp(17.625 * t / (243.04 + t))
    return clip(100.0 * magnus(dew_c) / magnus(temp_c), 0.0, 100.0)


def wind_from(u: Column, v: Column) -> Column:
    """Degrees clockwise from north that the wind blows from."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def danger_category(fm: Column, rh: Column, wind: Column) -> Column:
    """0 (low) to 4 (extreme), null where an input is null or not finite."""
    known = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in (fm, rh, wind)]
    elevated = ((rh < ELEVATED_RH) & (wind >= ELEVATED_WIND)) | ((rh < VERY_DRY_RH) & (wind >= VERY_DRY_WIND))
    return (
        F.when(~(known[0] & known[1] & known[2]), F.lit(None))
        .when(fm >= LOW_FM, 0)
        .when((fm < EXTREME_FM) & (rh < EXTREME_RH) & (wind >= EXTREME_WIND), 4)
        .when((fm < ELEVATED_FM) & (rh < CRITICAL_RH) & (wind >= CRITICAL_WIND), 3)
        .when((fm < ELEVATED_FM) & elevated, 2)
        .when((rh < MODERATE_RH) | (wind >= MODERATE_WIND), 1)
        .otherwise(0)
        .cast("int")
    )


def report_category(fm: Column, rh: Column, wind: Column) -> Column:
    """The end-of-day reports' variant: its elevated class asks for 25 % and 10 knots, or 35 % and 15."""
    elevated = ((rh < 25) & (wind >= 10)) | ((rh < 35) & (wind >= 15))
    return (
        F.when(fm.isNull() | rh.isNull() | wind.isNull(), F.lit(None))
        .when((fm < 7) & (rh < 20) & (wind >= 25), 4)
        .when((fm < 9) & (rh < 25) & (wind >= 15), 3)
        .when((fm < 9) & elevated, 2)
        .when((fm < 15) & ((rh < 45) | (wind >= 10)), 1)
        .otherwise(0)
        .cast("int")
    )


def fahrenheit(temp_c: Column) -> Column:
    return temp_c * 9.0 / 5.0 + 32.0


def lon180(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def celsius(temp: Column) -> Column:
    """Kelvin is told by values above 150."""
    return F.when(temp > 150, temp - 273.15).otherwise(temp)


def precip_mm(value: Column, unit: Column) -> Column:
    """Millimetres; a unit that isn't known is an error."""
    return (
        F.when(unit.isin("kg m-2", "kg m**-2", "mm"), value)
        .when(unit == "m", value * 1000.0)
        .when(unit.isin("in", "inch"), value * 25.4)
        .otherwise(F.raise_error(F.concat(F.lit("precipitation unit: "), F.coalesce(unit, F.lit("none")))).cast("double"))
    )


# Fixed value: the share of the wind at ten metres that fires meet
FIRE_WIND = 0.8


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def aspect_degrees(sine: Column, cosine: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sine, cosine)) + 360.0, F.lit(360.0))
