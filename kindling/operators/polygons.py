"""Points in many polygons, held in a table: polygons are filed in the cells that they cover, at a width that fits their size.

A cell wholly inside a polygon settles its points without a test; a cell that an edge may cross carries only the edges
that reach its band of latitudes, all that a ray can meet. Points look up their cell at each width in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.operators.shared import BROADCAST_ROWS, cut

#: A polygon covers 4 to 9 cells of its level along its longer side, unless it is wider or smaller than the levels go.
ACROSS, LEVELS = 4, (0, 24)
#: Points of one cell in a task.
PER_TASK = 100_000


def edges(ring: Column) -> Column:
    """The edges of a ring, an array of structs (lon, lat), closed or not, as structs (x1, y1, x2, y2); level ones never count."""
    at = F.transform(ring, lambda a, i: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), F.get(ring, (i + 1) % F.size(ring))["lon"].alias("x2"), F.get(ring, (i + 1) % F.size(ring))["lat"].alias("y2")))
    return F.filter(at, lambda e: e["y1"] != e["y2"])


def within(lat: Column, lon: Column, of: Column) -> Column:
    """Whether a point lies inside, by the parity of the edges that a ray to the east meets."""
    met = F.filter(of, lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(met) % 2 == 1


def cover(polygons: DataFrame, name: str, ring: str, order: str) -> DataFrame:
    """name, order, level, cy, cx, and edges: null where the cell lies inside, else those that reach the cell's latitudes."""
    p = polygons.select(F.col(name).alias("_name"), F.col(order).alias("_order"), edges(F.col(ring)).alias("_e"), F.transform(ring, lambda a: a["lon"]).alias("_xs"), F.transform(ring, lambda a: a["lat"]).alias("_ys")).where(F.size("_e") > 1)
    low_x, high_x, low_y, high_y = F.array_min("_xs"), F.array_max("_xs"), F.array_min("_ys"), F.array_max("_ys")
    level = F.least(F.greatest(F.floor(F.log2(360.0 * 2 * ACROSS / F.greatest(high_x - low_x, high_y - low_y))), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")
    p = p.withColumn("_level", level).withColumn("_w", F.lit(360.0) / F.pow(F.lit(2.0), "_level"))
    span = lambda a, b: F.sequence(F.floor(a / F.col("_w")), F.floor(b / F.col("_w")))
    p = p.withColumn("_band", F.explode(span(low_y, high_y))).withColumns({"_y0": F.col("_band") * F.col("_w"), "_y1": (F.col("_band") + 1) * F.col("_w")})
    reach = F.filter("_e", lambda e: (F.least(e["y1"], e["y2"]) <= F.col("_y1")) & (F.greatest(e["y1"], e["y2"]) >= F.col("_y0")))
    p = p.withColumn("_edges", reach).withColumn("_col", F.explode(span(low_x, high_x))).withColumns({"_x0": F.col("_col") * F.col("_w"), "_x1": (F.col("_col") + 1) * F.col("_w")})
    crossed = F.exists("_edges", lambda e: (F.least(e["x1"], e["x2"]) <= F.col("_x1")) & (F.greatest(e["x1"], e["x2"]) >= F.col("_x0")))
    # a level edge meets no ray, yet a cell that it crosses is not all inside or all outside
    flat = F.exists(F.zip_with("_ys", F.concat(F.slice("_ys", 2, F.greatest(F.size("_ys") - 1, F.lit(0))), F.slice("_ys", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: (s["a"] == s["b"]) & s["a"].between(F.col("_y0"), F.col("_y1")))
    inside = within((F.col("_y0") + F.col("_y1")) / 2, (F.col("_x0") + F.col("_x1")) / 2, F.col("_edges"))
    p = p.withColumn("_open", crossed | flat).withColumn("_in", inside).where("_open or _in")
    return p.select(F.col("_name").alias("name"), F.col("_order").alias("order"), F.col("_level").alias("level"), F.col("_band").alias("cy"), F.col("_col").alias("cx"), F.when(F.col("_open"), F.col("_edges")).alias("edges"))


def first_of(points: DataFrame, polygons: DataFrame, key: str, name: str = "name", ring: str = "ring", order: str = "order", out: str = "polygon") -> DataFrame:
    """points with `out`, the name of the first polygon by `order` (ties: the smaller name) that holds their lat and lon; null without one.

    Points are told apart by `key`; rows of one key at several places get what the first of their polygons is. Null and NaN
    coordinates and null keys lie nowhere. Rings with fewer than three corners hold nothing; those over the date line are to be split first. A cell with very many places is dealt over tasks. Points of one place look once, and of equal rings the first is filed.
    """
    first = polygons.select(F.col(order).alias("order"), F.col(name).alias("name"), F.col(ring).alias("ring"), F.col(ring).cast("string").alias("_k")).repartition("_k")
    first = cut(first.groupBy("_k").agg(F.min(F.struct("order", "name", "ring")).alias("_f")).select("_f.*"))  # equal rings have equal text
    filed = cut(cover(first, "name", "ring", "order"))
    levels = [r.level for r in filed.select("level").distinct().collect()]  # 25 at most
    if not levels:
        return points.withColumn(out, F.lit(None).cast(polygons.schema[name].dataType))
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    at_cells = F.array(*(F.struct(F.lit(v).alias("level"), F.floor(F.col("_lat") / (360.0 / 2**v)).alias("cy"), F.floor(F.col("_lon") / (360.0 / 2**v)).alias("cx")) for v in levels))
    cell = ["level", "cy", "cx"]
    asking = points.where(F.col(key).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)).select(F.col(key).alias("_key"), lat.alias("_lat"), lon.alias("_lon"))
    looks = cut(asking.select("_lat", "_lon").distinct()).select("_lat", "_lon", F.explode(at_cells).alias("c")).select("_lat", "_lon", "c.*")
    rows = looks.groupBy(*cell).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    deals = cut(rows.where(F.col("n") > max(PER_TASK, total // BROADCAST_ROWS)).select(*cell, F.ceil(F.col("n") / PER_TASK).cast("int").alias("deals")))  # fewer than BROADCAST_ROWS by arithmetic
    dealt = lambda df: df.join(F.broadcast(deals), cell, "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    looks = dealt(looks).withColumn("deal", F.pmod(F.xxhash64("_lat", "_lon"), F.col("deals"))).drop("deals")
    filed = dealt(filed).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals").cast("long") - 1))).drop("deals")
    held = looks.join(filed, [*cell, "deal"]).where(F.col("edges").isNull() | within(F.col("_lat"), F.col("_lon"), F.col("edges")))
    found = held.groupBy("_lat", "_lon").agg(F.min(F.struct("order", "name")).alias("_found"))
    found = asking.join(found, ["_lat", "_lon"]).groupBy("_key").agg(F.min("_found").alias("_found"))
    return points.join(found, F.col(key) == F.col("_key"), "left").select(*(points[c] for c in points.columns), F.col("_found.name").alias(out))
