"""Regridding from scattered places."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators import scattered
from kindling.plans.common import LAT, LON, place, r, registry, table

QUERIES, ORACLES, query = registry()

#: Places of customers, and of suppliers drawn into the middle of theirs.
PLACES = f"""p AS (SELECT c_custkey AS pid, {LON.format("c_custkey")} AS x, {LAT.format("c_custkey")} AS y FROM customer),
    t AS (SELECT s_suppkey AS dst, -92 + ({LON.format("s_suppkey")} + 92) / 4 AS x, 38.5::DOUBLE + ({LAT.format("s_suppkey")} - 38.5::DOUBLE) / 4 AS y FROM supplier)"""


def _places(spark, sf_dir):
    p = place(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").cast("long").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    t = place(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").cast("long").alias("dst"), (-92 + (F.col("lon") + 92) / 4).alias("x"), (38.5 + (F.col("lat") - 38.5) / 4).alias("y"))
    return p, t


@query(f"""WITH {PLACES} SELECT dst, 3 AS corners, round(2 * x - 3 * y, 6) AS value FROM t""")
def scattered_linear(spark, sf_dir):
    """A plane's values at scattered places, regridded by their triangulation, are the plane's at the targets."""
    places, targets = _places(spark, sf_dir)
    w = scattered.barycentric(scattered.triangles(places), places, targets)
    values = places.select("pid", F.lit(1).alias("k"), (2 * F.col("x") - 3 * F.col("y")).alias("value"))
    corners = w.groupBy("dst").agg(F.count("*").cast("int").alias("corners"))
    return scattered.regridded(values, w, ["k"]).join(corners, "dst").select("dst", "corners", r(F.col("value")).alias("value"))


@query(f"""WITH {PLACES}, d AS (SELECT dst, pid, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS far FROM t, p)
    SELECT dst, round(min(far), 6) AS distance FROM d GROUP BY dst""")
def scattered_nearest(spark, sf_dir):
    """How far the place next to each target is."""
    places, targets = _places(spark, sf_dir)
    return scattered.nearest(places, targets).select("dst", r(F.col("distance")).alias("distance"))
