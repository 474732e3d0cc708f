"""Smoothing in two passes against a sum over the square of every cell."""

import math

import pytest

from kindling.operators import grids


def brute(cells, sigma, reach, shape):
    def at(i, n):
        return -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i

    out = {}
    for (g, y, x), _ in cells.items():
        s = w = 0.0
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                v = cells.get((g, at(y + dy, shape[0]), at(x + dx, shape[1])) if shape else (g, y + dy, x + dx))
                if v is not None:
                    k = math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))
                    s, w = s + k * v, w + k
        out[g, y, x] = s / w if w else None
    return out


@pytest.mark.parametrize("mirrored", [True, False])
def test_two_passes(spark, mirrored):
    cells = {(g, y, x): None if (y * 7 + x * 3 + g) % 5 == 0 or (g == 1 and x < 6) else float(y * x % 11) for g in (0, 1) for y in range(6) for x in range(9)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "g int, row int, col int, value double")
    got = grids.smoothed(df, 1.0, (6, 9), ["g"]) if mirrored else grids.gaussian(df, 0.8, 2, ["g"])
    want = brute(cells, 1.0, 4, (6, 9)) if mirrored else brute(cells, 0.8, 2, None)
    rows = got.collect()
    assert len(rows) == len(cells)
    for r in rows:
        assert r.smoothed == (None if want[r.g, r.row, r.col] is None else pytest.approx(want[r.g, r.row, r.col]))
    assert mirrored or any(v is None for v in want.values())


def test_ruggedness_with_holes_and_high_ground(spark):
    cells = {(y, x): None if (y, x) == (1, 1) else 1e6 + y * x % 4 for y in range(4) for x in range(5)}
    df = spark.createDataFrame([(0, *k, v) for k, v in cells.items()], "g int, row int, col int, value double")
    near = lambda i, n: [min(max(i + d, 0), n - 1) for d in (-1, 0, 1)]  # noqa: E731  with a reach of one, the mirror is the edge
    for r in grids.ruggedness(df, (4, 5), ["g"]).collect():
        v = [cells[y, x] for y in near(r.row, 4) for x in near(r.col, 5) if cells[y, x] is not None]
        want = math.sqrt(sum((a - sum(v) / len(v)) ** 2 for a in v) / len(v))
        assert r.ruggedness == (None if r.value is None else pytest.approx(want, abs=1e-6))
