"""Calendar and clock expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def hour_half_even(ts: Column) -> Column:
    """Nearest hour as microseconds since 1970; half hours go to the even hour."""
    whole, rest = F.floor(micros(ts) / HOUR), F.pmod(micros(ts), F.lit(HOUR))
    up = (rest > HOUR // 2) | ((rest == HOUR // 2) & (F.pmod(whole, F.lit(2)) == 1))
    return ((whole + up.cast("long")) * HOUR).cast("long")


def year_cycle(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day's place in its own year, leap years included."""
    leap = (F.year(day) % 4 == 0) & ((F.year(day) % 100 != 0) | (F.year(day) % 400 == 0))
    turn = 2 * math.pi * (F.dayofyear(day) - 1) / F.when(leap, 366).otherwise(365)
    return F.sin(turn), F.cos(turn)


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th such weekday (Monday is 0) of a month; the last one if n is -1."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def federal_holiday(day: Column) -> Column:
    """Whether a US federal holiday is observed: fixed dates on Saturday move to Friday, on Sunday to Monday."""
    y = F.year(day)
    fixed = [(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)]
    found = F.lit(False)
    for year in (y, y + 1):
        for m, d in fixed:
            at = F.make_date(year, F.lit(m), F.lit(d))
            moved = F.when(F.weekday(at) == 5, F.date_sub(at, 1)).when(F.weekday(at) == 6, F.date_add(at, 1)).otherwise(at)
            found = found | (day == moved)
    for m, w, n in [(1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4)]:
        found = found | (day == nth_weekday(y, m, w, n))
    return found


def season_year(day: Column, month: int = 3) -> Column:
    """The year in which the day's season began, on the first of `month`."""
    return F.year(day) - (F.month(day) < month).cast("int")


def episode(day: Column, days: int = 14, origin: str = "2000-01-01") -> Column:
    return F.floor(F.datediff(day, F.lit(origin).cast("date")) / days).cast("long")


def turn(day: Column, length: float, first: int) -> Column:
    """The day's place on a circle of `length` days, the first of January at (1 - first) of them."""
    return 2 * math.pi * (F.dayofyear(day) - first) / length


def month_dummies(day: Column) -> dict[int, Column]:
    """0 or 1 for each month from February on."""
    return {m: (F.month(day) == m).cast("int") for m in range(2, 13)}
