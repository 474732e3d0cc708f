"""Points in many polygons, and runs that members of an ensemble take."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators import cycles, polygons
from kindling.plans.common import LAT, LON, place, r, registry, table

QUERIES, ORACLES, query = registry()

#: A pentagon with a dent around each part's place, of one of seven sizes.
CORNERS = [(-1.0, -0.8), (1.0, -0.5), (0.3, 0.1), (0.8, 0.9), (-0.7, 0.6)]
PX, PY, SIZE = f"({LON.format('p_partkey')} + 0.0037)", f"({LAT.format('p_partkey')} + 0.0041)", "(0.03 + (p_partkey % 7) * 0.021::DOUBLE)"
#: Edges are unnested, and an edge counts if a ray to the east meets it.
HELD = f"""e AS (SELECT p_partkey AS part, {PX} + a.x * {SIZE} AS x1, {PY} + a.y * {SIZE} AS y1, {PX} + b.x * {SIZE} AS x2, {PY} + b.y * {SIZE} AS y2
        FROM part, (VALUES {', '.join(f'({i}, {x}::DOUBLE, {y}::DOUBLE)' for i, (x, y) in enumerate(CORNERS))}) a(i, x, y) JOIN (VALUES {', '.join(f'({(i - 1) % 5}, {x}::DOUBLE, {y}::DOUBLE)' for i, (x, y) in enumerate(CORNERS))}) b(i, x, y) ON a.i = b.i),
    c AS (SELECT c_custkey, {LAT.format('c_custkey')} AS lat, {LON.format('c_custkey')} AS lon FROM customer),
    h AS (SELECT c_custkey, min(part) AS part FROM (SELECT c_custkey, part FROM c JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY c_custkey)"""


def _located(spark, sf_dir):
    k = F.col("p_partkey")
    size = 0.03 + (k % 7) * 0.021
    x, y = F.col("lon") + 0.0037, F.col("lat") + 0.0041
    ring = F.array(*(F.struct((x + F.lit(a) * size).alias("lon"), (y + F.lit(b) * size).alias("lat")) for a, b in CORNERS))
    shapes = place(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("name"), k.alias("order"), ring.alias("ring"))
    return polygons.first_of(place(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "lat", "lon"), shapes, "c_custkey")


@query(f"""WITH {HELD} SELECT c_custkey, part AS polygon FROM c LEFT JOIN h USING (c_custkey)""")
def first_of_many_polygons(spark, sf_dir):
    """The first of as many polygons as there are parts that holds each customer's place."""
    return _located(spark, sf_dir).select("c_custkey", "polygon")


@query(f"""WITH {HELD}, n AS (SELECT l_partkey AS part, count(*) AS years, round(avg(l_quantity), 6) AS normal FROM lineitem GROUP BY ALL HAVING count(*) >= 5)
    SELECT c_custkey, part AS polygon, years, normal FROM h JOIN n USING (part)""")
def normal_by_polygon(spark, sf_dir):
    """From a place to its polygon, from there to the polygon's normal, where that rests on five values."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("polygon")).agg(F.count("*").alias("years"), r(F.avg("l_quantity")).alias("normal")).where("years >= 5")
    return _located(spark, sf_dir).join(n, "polygon").select("c_custkey", "polygon", "years", "normal")


#: Three members share a source and step back; one looks a run ahead.
MEMBERS = [("a1", "0", 0), ("a2", "0", 0), ("a3", "0", 0), ("b1", "1", -12), ("b2", "1", 6), ("c1", "2", 0)]
HOURS = 24


@query(f"""WITH RECURSIVE s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{m}', '{s}', {o})" for i, (m, s, o) in enumerate(MEMBERS))}) t(i, member, source, off)),
    m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS n FROM s),
    a AS (SELECT DISTINCT datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 24 + 12 AS anchor FROM orders WHERE o_orderkey % 3 = 0),
    q AS (SELECT DISTINCT CAST(o_custkey % 3 AS VARCHAR) AS source, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 24 + 6 * (o_orderkey % 4) AS cycle FROM orders),
    f AS (SELECT anchor, m.source, m.member, m.n, list(cycle ORDER BY cycle DESC) FILTER (cycle IS NOT NULL) AS cs FROM a, m LEFT JOIN q ON q.source = m.source AND cycle BETWEEN anchor - {HOURS} AND anchor + off AND cycle + 3 <= anchor GROUP BY ALL),
    w AS (SELECT anchor, source, member, n, cs[1] AS cycle, cs[1] AS newest, CASE WHEN len(cs) > 0 THEN [cs[1]] ELSE [] END AS taken FROM f WHERE n = 1
        UNION ALL SELECT f.anchor, f.source, f.member, f.n, list_filter(cs, lambda c: NOT list_contains(w.taken, c))[1], cs[1], list_concat(w.taken, list_filter(cs, lambda c: NOT list_contains(w.taken, c))[1:1]) FROM w JOIN f ON f.anchor = w.anchor AND f.source = w.source AND f.n = w.n + 1)
    SELECT anchor, member, source, cycle, anchor - cycle AS age, CASE WHEN cycle IS NULL THEN 'unavailable' WHEN cycle < newest THEN 'stepped_back' ELSE 'target' END AS status FROM w""")
def cycles_claimed(spark, sf_dir):
    """For each day the run that each member takes: the newest of its source that no member before it has, at the time three hours out."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 24
    o = table(spark, sf_dir, "orders")
    runs = o.select((F.col("o_custkey") % 3).cast("string").alias("source"), (day + 6 * (F.col("o_orderkey") % 4)).alias("cycle"))
    return cycles.resolved(o.where("o_orderkey % 3 = 0").select((day + 12).alias("anchor")), MEMBERS, runs, HOURS, latency=F.lit(3))
