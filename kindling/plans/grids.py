"""Grids: smoothing, regridding, terrain, antecedent sums, masks, sequences and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators import geo, grids, ranks
from kindling.plans.common import r, registry, table
from kindling.plans.evidence import GRID, _grid
from kindling.plans.relations import RINGS, _inside

QUERIES, ORACLES, query = registry()

HOLES = f"(SELECT vec_id, row, col, CASE WHEN (row * 8 + col) % 5 <> 0 THEN value END AS value FROM {GRID} WHERE row < 8)"
_mirror = lambda e: f"(CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= 8 THEN 15 - ({e}) ELSE {e} END)"


def _holes(spark, sf_dir):
    return _grid(spark, sf_dir).where("row < 8").select("vec_id", "row", "col", F.when((F.col("row") * 8 + F.col("col")) % 5 != 0, F.col("value")).alias("value"))


def _smooth_sql(source, restore):
    return f"""WITH g AS MATERIALIZED ({source}), o AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, exp(-(y * y + x * x) / 2.0::DOUBLE) AS w FROM range(-4, 5) a(y), range(-4, 5) b(x)),
n AS (SELECT a.vec_id, a.row, a.col, any_value(a.own) AS own, sum(w * b.value) / sum(w) AS s FROM (SELECT g.*, o.* FROM g, o) a JOIN g b ON b.vec_id = a.vec_id AND b.value IS NOT NULL AND b.row = {_mirror('a.row + a.y')} AND b.col = {_mirror('a.col + a.x')} GROUP BY ALL)
SELECT vec_id, count({restore}) AS cells, round(sum({restore}), 4) AS total FROM n GROUP BY vec_id"""


@query(_smooth_sql(f"SELECT *, value AS own FROM {HOLES}", "s"))
def mirrored_gauss(spark, sf_dir):
    """Smoothing that leaves out missing cells, with mirrored edges, cut at four sigma."""
    return grids.smoothed(_holes(spark, sf_dir), 1.0, (8, 8), ["vec_id"]).groupBy("vec_id").agg(F.count("smoothed").alias("cells"), r(F.sum("smoothed"), 4).alias("total"))


@query(_smooth_sql(f"SELECT vec_id, row, col, value AS own, coalesce(value, avg(value) OVER (PARTITION BY vec_id)) AS value FROM {HOLES}", "CASE WHEN own IS NOT NULL THEN s END"))
def mean_filled_gauss(spark, sf_dir):
    """Smoothing over gaps filled with the mean; the gaps themselves stay."""
    return grids.smoothed(_holes(spark, sf_dir), 1.0, (8, 8), ["vec_id"], fill_mean=True).groupBy("vec_id").agg(F.count("smoothed").alias("cells"), r(F.sum("smoothed"), 4).alias("total"))


@query(f"""WITH g AS MATERIALIZED (SELECT * FROM {HOLES}), p AS (SELECT CAST(i AS INT) AS dst, i % 9 * 0.85::DOUBLE + 0.1::DOUBLE AS y, i // 9 * 1.1::DOUBLE + 0.35::DOUBLE AS x FROM range(0, 63) t(i)), q AS (SELECT dst, CAST(floor(y) AS INT) AS a, CAST(floor(x) AS INT) AS b, y - floor(y) AS fy, x - floor(x) AS fx FROM p),
w AS (SELECT * FROM (SELECT dst, a AS row, b AS col, CASE WHEN fx >= fy THEN 1 - fx ELSE 1 - fy END AS w FROM q UNION ALL SELECT dst, CASE WHEN fx >= fy THEN a ELSE a + 1 END, CASE WHEN fx >= fy THEN b + 1 ELSE b END, abs(fx - fy) FROM q UNION ALL SELECT dst, a + 1, b + 1, least(fx, fy) FROM q) WHERE w > 0),
s AS (SELECT k.vec_id, w.dst, count(*) AS need, count(g.value) AS got, sum(w.w * g.value) AS v FROM (SELECT DISTINCT vec_id FROM g) k CROSS JOIN w LEFT JOIN g ON g.vec_id = k.vec_id AND g.row = w.row AND g.col = w.col GROUP BY ALL)
SELECT vec_id, count(*) AS targets, count(*) FILTER (got = need) AS covered, round(sum(v) FILTER (got = need), 4) AS total FROM s GROUP BY vec_id""")
def triangle_regrid(spark, sf_dir):
    """Values at other points from the three corners around each; null where one of them is missing."""
    i = F.col("id")
    points = spark.range(63).select(i.cast("int").alias("dst"), (i % 9 * 0.85 + 0.1).alias("y"), (F.floor(i / 9) * 1.1 + 0.35).alias("x"))
    out = grids.regridded(_holes(spark, sf_dir), grids.triangle_weights(points), ["vec_id"])
    return out.groupBy("vec_id").agg(F.count("*").alias("targets"), F.count("value").alias("covered"), r(F.sum("value"), 4).alias("total"))


@query(f"""WITH g AS MATERIALIZED (SELECT vec_id, row, col, value FROM {GRID}), b AS (SELECT vec_id, min(row) AS a, max(row) AS b, min(col) AS c, max(col) AS d FROM g WHERE value > 0.15 GROUP BY vec_id) SELECT vec_id, count(*) AS cells, round(sum(value), 4) AS total FROM g JOIN b USING (vec_id) WHERE row BETWEEN a AND b AND col BETWEEN c AND d GROUP BY vec_id""")
def crop_to_mask(spark, sf_dir):
    return grids.cropped(_grid(spark, sf_dir).drop("label"), F.col("value") > 0.15, ["vec_id"]).groupBy("vec_id").agg(F.count("*").alias("cells"), r(F.sum("value"), 4).alias("total"))


@query(f"""WITH g AS MATERIALIZED (SELECT vec_id, row, col, value FROM {GRID}), d AS (SELECT *, CASE WHEN lag(value) OVER y IS NULL THEN (lead(value) OVER y - value) / 2 WHEN lead(value) OVER y IS NULL THEN (value - lag(value) OVER y) / 2 ELSE (lead(value) OVER y - lag(value) OVER y) / 4 END AS dy,
CASE WHEN lag(value) OVER x IS NULL THEN (lead(value) OVER x - value) / 3 WHEN lead(value) OVER x IS NULL THEN (value - lag(value) OVER x) / 3 ELSE (lead(value) OVER x - lag(value) OVER x) / 6 END AS dx FROM g WINDOW y AS (PARTITION BY vec_id, col ORDER BY row), x AS (PARTITION BY vec_id, row ORDER BY col))
SELECT vec_id, round(avg(degrees(atan(sqrt(dx * dx + dy * dy)))), 5) AS slope, round(avg(atan2(-dx, dy)), 5) AS aspect FROM d GROUP BY vec_id""")
def terrain_derivatives(spark, sf_dir):
    t = grids.terrain(_grid(spark, sf_dir).drop("label"), 2.0, 3.0, ["vec_id"])
    return t.groupBy("vec_id").agg(r(F.avg("slope"), 5).alias("slope"), r(F.avg("aspect"), 5).alias("aspect"))


@query(f"""WITH g AS MATERIALIZED (SELECT vec_id, row, col, value FROM {GRID}), o AS (SELECT a.vec_id, a.row, a.col, least(greatest(a.row + y, 0), 7) AS r, least(greatest(a.col + x, 0), 7) AS c FROM g a, range(-1, 2) t(y), range(-1, 2) u(x)),
s AS (SELECT o.vec_id, o.row, o.col, stddev_pop(value) AS s FROM o JOIN g ON g.vec_id = o.vec_id AND g.row = r AND g.col = c GROUP BY ALL) SELECT vec_id, count(*) AS cells, round(avg(s), 5) AS mean, round(max(s), 5) AS most FROM s GROUP BY vec_id""")
def terrain_ruggedness(spark, sf_dir):
    """The spread of the cells around each, over mirrored edges."""
    t = grids.ruggedness(_grid(spark, sf_dir).drop("label"), (8, 8), ["vec_id"])
    return t.groupBy("vec_id").agg(F.count("ruggedness").alias("cells"), r(F.avg("ruggedness"), 5).alias("mean"), r(F.max("ruggedness"), 5).alias("most"))


@query(f"""WITH g AS MATERIALIZED (SELECT vec_id % 10 AS tile, vec_id // 10 AS day, row, col, value FROM {GRID}) SELECT a.tile, a.day, count(*) AS cells, round(sum(coalesce(s, 0)), 4) AS before3 FROM g a LEFT JOIN (SELECT a.tile, a.day, a.row, a.col, sum(b.value) AS s FROM g a JOIN g b ON b.tile = a.tile AND b.row = a.row AND b.col = a.col AND b.day BETWEEN a.day - 3 AND a.day - 1 GROUP BY ALL) b USING (tile, day, row, col) GROUP BY ALL""")
def antecedent_grid(spark, sf_dir):
    """Each cell's sum over the three days before."""
    g = _grid(spark, sf_dir).select((F.col("vec_id") % 10).alias("tile"), F.floor(F.col("vec_id") / 10).alias("day"), "row", "col", "value")
    return grids.antecedent(g, "day", 3, ["tile"]).groupBy("tile", "day").agg(F.count("*").alias("cells"), r(F.sum("antecedent"), 4).alias("before3"))


@query(f"""SELECT vec_id, count(*) AS inside, round(avg(value), 5) AS mean FROM (SELECT vec_id, value, 36 + row * 0.5::DOUBLE AS lat, -95 + col * 0.5::DOUBLE AS lon FROM {GRID}) WHERE {_inside(RINGS['west'])} GROUP BY vec_id""")
def polygon_mask(spark, sf_dir):
    """The cells whose centres lie in a polygon."""
    g = _grid(spark, sf_dir).withColumns({"lat": 36 + F.col("row") * 0.5, "lon": -95 + F.col("col") * 0.5})
    return g.where(geo.inside(F.col("lat"), F.col("lon"), RINGS["west"])).groupBy("vec_id").agg(F.count("*").alias("inside"), r(F.avg("value"), 5).alias("mean"))


@query("""WITH g AS (SELECT o_custkey AS grp, o_orderkey AS step, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS v FROM orders), s AS (SELECT grp, count(*) AS n, count(*) FILTER (v IS NULL) AS void FROM g GROUP BY grp), u AS (SELECT arg_max(n, (c, n)) AS n FROM (SELECT n, count(*) AS c FROM s GROUP BY n))
SELECT grp, count(*) AS steps, round(arg_min(v, step), 2) AS first, round(arg_max(v, step), 2) AS last FROM g WHERE grp IN (SELECT s.grp FROM s, u WHERE s.n = u.n AND void = 0) GROUP BY grp""")
def complete_sequences(spark, sf_dir):
    """Series of the usual length without a gap, as arrays."""
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("v"))
    s = grids.complete_sequences(g, ["grp"], "step", ["v"])
    return s.select("grp", F.size("steps").cast("long").alias("steps"), r(F.col("steps")[0]["v"], 2).alias("first"), r(F.element_at("steps", -1)["v"], 2).alias("last"))


@query(f"""SELECT label, col AS channel, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, bool_and(abs(value) <= 10) AS in_range, bool_and(value = value) AS finite FROM {GRID} GROUP BY ALL""")
def channel_statistics(spark, sf_dir):
    """Mean and spread of each channel, and whether its values are in range and finite."""
    v = F.col("value")
    return _grid(spark, sf_dir).groupBy("label", F.col("col").alias("channel")).agg(F.count("*").alias("n"), r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("std"), F.bool_and(F.abs(v) <= 10).alias("in_range"), F.bool_and(~F.isnan(v)).alias("finite"))


@query("""WITH p AS (SELECT c_custkey AS k, 36 + (c_custkey * 37 % 500) / 100.0::DOUBLE AS lat FROM customer), s AS (SELECT lat - lag(lat) OVER (ORDER BY lat) AS gap FROM (SELECT DISTINCT lat FROM p)) SELECT round(median(gap) * 110.574::DOUBLE, 6) AS km FROM s WHERE gap IS NOT NULL""")
def cell_spacing(spark, sf_dir):
    """The median distance from one row of a grid to the next."""
    lat = table(spark, sf_dir, "customer").select((36 + (F.col("c_custkey") * 37 % 500) / F.lit(100.0)).alias("lat")).distinct()
    gaps = ranks.carried(lat, [], ["lat"], {"before": F.col("lat")}, own=False).select((F.col("lat") - F.col("before")).alias("gap"))
    return ranks.quantiles(gaps, [], "gap", {"gap": (0.5, "linear")}).select(r(F.col("gap") * 110.574).alias("km"))
