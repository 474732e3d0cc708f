"""Polygons of all sizes against a test of every pair; members and runs against a loop."""

import numpy as np
from pyspark.sql import functions as F

from kindling.operators import cycles, polygons

SHAPE = "name string, `order` int, ring array<struct<lon:double,lat:double>>"


def holds(ring, lat, lon):
    met = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            met = not met
    return met


def test_first_polygon_of_many(spark, monkeypatch):
    monkeypatch.setattr(polygons, "PER_TASK", 50)  # so that crowded cells are dealt
    monkeypatch.setattr(polygons, "BROADCAST_ROWS", 20)
    r = np.random.default_rng(1)
    shapes = [("box", 5, [(-95.0, 36.0), (-95.0, 41.0), (-89.0, 41.0), (-89.0, 36.0)]), ("closed", 4, [(-93.0, 37.0), (-93.0, 38.0), (-92.0, 38.0), (-93.0, 37.0)]), ("line", 0, [(-95.0, 36.0), (-89.0, 41.0)]), ("none", 0, [])]
    for i in range(60):
        x, y, size, n = r.uniform(-95, -89), r.uniform(36, 41), 10 ** r.uniform(-2, 0.3), int(r.integers(3, 12))
        turn = np.sort(r.random(n)) * 2 * np.pi
        shapes.append((f"p{i}", i % 7 + 1, [(float(x + size * f * np.cos(t)), float(y + size * f * np.sin(t))) for t, f in zip(turn, r.uniform(0.3, 1, n))]))
    points = [(i, float(r.uniform(35.5, 41.5)), float(r.uniform(-95.5, -88.5))) for i in range(600)] + [(600 + i, 37.5, -92.6) for i in range(300)]
    points += [(1000, None, -92.0), (1001, float("nan"), -92.0), (None, 38.0, -92.0), (1002, 37.5, -92.6)]
    df = spark.createDataFrame([(*p, "x") for p in points], "k int, lat double, lon double, name string")
    got = sorted((str(x.k), x.polygon) for x in polygons.first_of(df, spark.createDataFrame(shapes, SHAPE), "k").collect())
    want = []
    for k, lat, lon in points:
        hits = [] if k is None or lat is None or lat != lat else [(o, n) for n, o, ring in shapes if holds(ring, lat, lon)]
        want.append((str(k), min(hits)[1] if hits else None))
    assert got == sorted(want) and any(w[1] == "box" for w in want)


def test_no_polygons_and_no_points(spark):
    p, s = spark.createDataFrame([(1, 3.0, 2.0)], "k int, lat double, lon double"), spark.createDataFrame([("a", 1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)])], SHAPE)
    assert polygons.first_of(p, s.where("false"), "k").collect()[0].polygon is None
    assert polygons.first_of(p.where("false"), s, "k").count() == 0
    assert polygons.first_of(p, s, "k").collect()[0].polygon is None  # above the diagonal


def test_inner_cells_carry_no_edges(spark):
    ring = [(float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 2 * np.pi, 400, endpoint=False)]
    c = polygons.cover(spark.createDataFrame([("disc", 1, ring)], SHAPE), "name", "ring", "order").toPandas()
    assert len(c) <= 100 and c.edges.isna().sum() >= 4 and max(len(e) for e in c.edges.dropna()) < 200


def test_members_step_back(spark):
    r = np.random.default_rng(2)
    members = [("m1", "s", 0), ("m2", "s", 0), ("t1", "t", -6), ("m3", "s", 6), ("t2", "t", 0), ("u", "never", 0)]
    runs = {(s, int(h)) for s in "st" for h in r.integers(0, 60, 14) * 6}
    anchors = [int(a) for a in r.integers(0, 360, 25)]
    got = cycles.resolved(spark.createDataFrame([(a,) for a in anchors + [anchors[0], None]], "anchor long"), members, spark.createDataFrame([*runs, ("s", None), (None, 6)], "source string, cycle long"), 30)
    want = set()
    for a in set(anchors):
        taken = set()
        for m, s, off in members:
            allowed = sorted((h for q, h in runs if q == s and a - 30 <= h <= a + off), reverse=True)
            free = [h for h in allowed if (s, h) not in taken]
            if free:
                taken.add((s, free[0]))
            want.add((a, m, free[0] if free else None, "unavailable" if not free else "stepped_back" if free[0] < allowed[0] else "target"))
    rows = got.collect()
    assert len(rows) == len(want) and {(x.anchor, x.member, x.cycle, x.status) for x in rows} == want
    assert {w[3] for w in want} == {"target", "stepped_back", "unavailable"}


def test_latency_hides_runs_not_yet_out(spark):
    a, runs = spark.createDataFrame([(12,)], "anchor long"), spark.createDataFrame([("s", 12, 4), ("s", 6, 4), ("s", 6, 9)], "source string, cycle long, late int")
    assert cycles.resolved(a, [("m", "s", 0)], runs, 30, F.col("late")).first().cycle == 6
    assert cycles.resolved(a, [("m", "s", 0)], runs, 30).first().cycle == 12
