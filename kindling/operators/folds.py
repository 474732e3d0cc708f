"""States that depend on the state before: one pass over an entity's rows in order.

Rows are dealt by entity, sorted within, and streamed through a step in Arrow batches with the state carried
from one to the next, so no series is ever held whole. What doesn't depend on the state (an
equilibrium, say) belongs in a column computed before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

SPINUP_DAYS = 90
#: Saturation in percent and scale in mm of the rain variants.
RAIN_VARIANTS = {"legacy": None, "rain25_scale2": (25.0, 2.0), "rain30_scale2": (30.0, 2.0), "rain30_scale4": (30.0, 4.0)}
#: Hours of the three fuel classes, what a mm of rain adds to each, the least rain that does, the driest and wettest.
CLASS_HOURS, CLASS_GAIN, CLASS_RAIN, DRIEST, WETTEST = (1.0, 10.0, 100.0), (0.5, 0.15, 0.05), 0.5, 1.0, 40.0


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: tuple | None, step: Callable, names: list[str]) -> DataFrame:
    """keys, order, columns and the state after each row as doubles. step(state, *values) gives the next state, a tuple of floats; `start` is the state before the first."""
    rows = df.select(*keys, *order, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        key, state = None, start
        for b in batches:
            own, values = zip(*(b.column(k).to_pylist() for k in keys)), zip(*(b.column(c).to_pylist() for c in columns))
            out = []
            for k, v in zip(own, values):
                if k != key:
                    key, state = k, start
                state = step(state, *v)
                out.append(state)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.float64()) for x in zip(*out))], [*b.schema.names, *names])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + "".join(f", {n} double" for n in names))


def drought(annual_mm: float, gate: bool = True) -> Callable:
    """A day of the Keetch-Byram index in hundredths of an inch, from Celsius and mm. With `gate` nothing dries at 50 F or below."""
    scale = 1.0 + 10.88 * math.exp(-0.0441 * annual_mm / 25.4)

    def step(state, temp_c, rain_mm):
        hot = temp_c * 9.0 / 5.0 + 32.0
        wet = max(0.0, state[0] - max(0.0, rain_mm / 25.4 - 0.2) * 100.0)
        dried = max(0.0, (800.0 - wet) * (0.968 * math.exp(0.0486 * hot) - 8.30) * 1e-3 / scale) if hot > 50.0 or not gate else 0.0
        return (min(800.0, wet + dried),)

    return step


def moisture(rain: tuple[float, float] | None = None, dry_hours: float = 10.0, wet_hours: float = 6.0) -> Callable:
    """An hour of dead fuel moisture toward an equilibrium, slower when drying; rain (saturation, scale) wets it first."""
    dry, wet = 1.0 - math.exp(-1.0 / dry_hours), 1.0 - math.exp(-1.0 / wet_hours)

    def step(state, level, mm):
        now = state[0]
        if rain:
            now += (rain[0] - now) * (1.0 - math.exp(-max(0.0, mm or 0.0) / rain[1]))
        return (now + (level - now) * (dry if level < now else wet),)

    return step


def three_classes(state, level, mm):
    """An hour of the free 1, 10 and 100 hour fuels, which start at the first equilibrium; more than CLASS_RAIN of rain wets them."""
    if state is None:
        return (level,) * 3
    free = [s + (level - s) * (1.0 - math.exp(-1.0 / h)) for s, h in zip(state, CLASS_HOURS)]
    return tuple(min(s + g * mm, WETTEST) for s, g in zip(free, CLASS_GAIN)) if mm > CLASS_RAIN else tuple(free)
