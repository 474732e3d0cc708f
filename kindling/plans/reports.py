"""Reports over series and groups: spells, fills, climatology, skill, ranges and rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.operators import geo, tables
from kindling.plans.common import GREAT_CIRCLE, LAT, LON, events, place, r, registry, table

QUERIES, ORACLES, query = registry()


def _series():
    return Window.partitionBy("user_id").orderBy("at", "event_id")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (filled IS NULL) AS unfilled, round(sum(filled), 4) AS total FROM
(SELECT user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events) GROUP BY user_id""")
def forward_fill(spark, sf_dir):
    filled = F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(_series().rowsBetween(Window.unboundedPreceding, 0))
    return events(spark, sf_dir).withColumn("filled", filled).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("filled").isNull()).alias("unfilled"), r(F.sum("filled"), 4).alias("total"))


@query("""SELECT user_id, max(n) AS longest, round(max(s), 4) AS largest FROM (SELECT user_id, g, count(*) AS n, sum(value) AS s FROM
(SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
WHERE event_type <> 'error' GROUP BY user_id, g) GROUP BY user_id""")
def spell_length_and_sum(spark, sf_dir):
    """Runs without an error, per user: the longest, and the largest sum of values."""
    breaks = F.sum((F.col("event_type") == "error").cast("int")).over(_series().rowsBetween(Window.unboundedPreceding, 0))
    spells = events(spark, sf_dir).withColumn("g", breaks).where("event_type <> 'error'").groupBy("user_id", "g").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return spells.groupBy("user_id").agg(F.max("n").alias("longest"), r(F.max("s"), 4).alias("largest"))


@query("""SELECT user_id, event_type AS state, n_states, n_states > 1 AS disputed FROM
(SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
JOIN (SELECT user_id, count(DISTINCT event_type) AS n_states FROM events GROUP BY user_id) USING (user_id) WHERE k = 1""")
def review_latest_state(spark, sf_dir):
    """The last review decides; reviewers who differ are flagged."""
    out = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("at", "event_id")).alias("state"), F.count_distinct("event_type").alias("n_states"))
    return out.withColumn("disputed", F.col("n_states") > 1)


@query("""WITH e AS (SELECT event_type, value, month(ts) AS m, hour(ts) // 6 AS b FROM events),
c AS (SELECT m, b, avg(value) AS mean FROM e GROUP BY m, b HAVING count(*) >= 100), o AS (SELECT avg(value) AS mean FROM e)
SELECT event_type, count(*) AS n, count(*) FILTER (c.mean IS NULL) AS fallback, round(avg(abs(value - coalesce(c.mean, o.mean))), 5) AS mae
FROM e LEFT JOIN c USING (m, b) CROSS JOIN o GROUP BY event_type""")
def climatology_fallback(spark, sf_dir):
    """Mean by month and quarter of the day where 100 rows support it, else the mean of all."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.month("ts").alias("m"), F.floor(F.hour("ts") / 6).alias("b"))
    cells = e.groupBy("m", "b").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where("n >= 100").drop("n")  # 48 rows at most
    overall = e.agg(F.avg("value").alias("overall"))  # one row
    joined = e.join(F.broadcast(cells), ["m", "b"], "left").crossJoin(F.broadcast(overall))
    error = F.abs(F.col("value") - F.coalesce("mean", "overall"))
    return joined.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("mean").isNull()).alias("fallback"), r(F.avg(error), 5).alias("mae"))


@query("""UNPIVOT (SELECT l_returnflag, min(l_quantity)::DOUBLE AS quantity_low, max(l_quantity)::DOUBLE AS quantity_high, min(l_discount)::DOUBLE AS discount_low, max(l_discount)::DOUBLE AS discount_high,
min(l_tax)::DOUBLE AS tax_low, max(l_tax)::DOUBLE AS tax_high FROM lineitem GROUP BY l_returnflag) ON COLUMNS(* EXCLUDE l_returnflag) INTO NAME feature VALUE bound""")
def feature_ranges(spark, sf_dir):
    aggs = [f(F.col(f"l_{c}").cast("double")).alias(f"{c}_{end}") for c in ("quantity", "discount", "tax") for f, end in ((F.min, "low"), (F.max, "high"))]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*aggs).unpivot("l_returnflag", None, "feature", "bound")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
a AS (SELECT day, v FROM d WHERE event_type = 'view'), b AS (SELECT day, v FROM d WHERE event_type = 'click')
SELECT coalesce(a.day, b.day) AS day, round(a.v, 5) AS view_mean, round(b.v, 5) AS click_mean, round(a.v - b.v, 5) AS delta FROM a FULL JOIN b ON a.day = b.day""")
def pairwise_series_delta(spark, sf_dir):
    """Two series by day, all days of either; one conditional aggregate needs no join."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    days = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).groupBy(F.to_date("ts").alias("day")).agg(mean("view").alias("a"), mean("click").alias("b"))
    return days.select("day", r(F.col("a"), 5).alias("view_mean"), r(F.col("b"), 5).alias("click_mean"), r(F.col("a") - F.col("b"), 5).alias("delta"))


@query("""SELECT n_name, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def many_to_one_lookup(spark, sf_dir):
    """Lookups whose keys must be unique; a repeated key fails the query."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    named = tables.many_to_one(tables.many_to_one(orders, customers, ["c_custkey"]), table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return named.groupBy("n_name").agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("""SELECT l_shipmonth, code, n FROM (SELECT *, row_number() OVER (PARTITION BY l_shipmonth ORDER BY n DESC, code) AS k FROM
(SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, CAST(l_quantity AS INT) AS code, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1""")
def dominant_code(spark, sf_dir):
    """The most frequent code of each month, the smaller of two as frequent."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"), F.col("l_quantity").cast("int").alias("code")).agg(F.count("*").alias("n"))
    return counts.groupBy("l_shipmonth").agg(F.max(F.struct("n", (-F.col("code")).alias("c"))).alias("x")).select("l_shipmonth", (-F.col("x.c")).alias("code"), "x.n")


@query("""WITH m AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS mean, var_pop(l_extendedprice) AS var, count(*) AS w FROM lineitem GROUP BY ALL),
p AS (SELECT l_returnflag, sum(w * mean) / sum(w) AS pooled, sum(w) AS total FROM m GROUP BY ALL)
SELECT l_returnflag, round(any_value(pooled), 4) AS pooled_mean, round(sqrt(sum(w * (var + (mean - pooled) * (mean - pooled))) / any_value(total)), 4) AS pooled_spread FROM m JOIN p USING (l_returnflag) GROUP BY l_returnflag""")
def pooled_mean_spread(spark, sf_dir):
    """A mixture of members: spread within them and between them; second moments need one pass."""
    w, mean = F.col("w"), F.col("mean")
    members = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("mean"), F.var_pop("l_extendedprice").alias("var"), F.count("*").alias("w"))
    both = members.withColumn("pooled", F.sum(w * mean).over(by := Window.partitionBy("l_returnflag")) / F.sum("w").over(by))
    spread = F.sqrt(F.sum(w * (F.col("var") + (mean - F.col("pooled")) ** 2)) / F.sum("w"))
    return both.groupBy("l_returnflag").agg(r(F.first("pooled"), 4).alias("pooled_mean"), r(spread, 4).alias("pooled_spread"))


@query("""WITH c AS (SELECT CAST(floor((l_quantity - 1) / 10) AS INT) AS category, avg((l_returnflag = 'R')::INT) AS rate, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT category, n, round(rate, 6) AS rate, coalesce(rate - lag(rate) OVER (ORDER BY category) >= -1e-9, true) AS rises FROM c""")
def event_rate_monotone(spark, sf_dir):
    """Whether the rate never falls from one category to the next; five rows reach the window."""
    rate = F.avg((F.col("l_returnflag") == "R").cast("int"))
    by = table(spark, sf_dir, "lineitem").groupBy(F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("category")).agg(rate.alias("x"), F.count("*").alias("n"))
    rises = F.coalesce(F.col("x") - F.lag("x").over(Window.orderBy("category")) >= -1e-9, F.lit(True))
    return by.select("category", "n", r(F.col("x")).alias("rate"), rises.alias("rises"))


@query("""WITH e AS (SELECT event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, avg(value) OVER (PARTITION BY event_type) AS usual FROM events)
SELECT event_type, count(*) AS n, round(1 - avg(abs(value - before)) / avg(abs(value - usual)), 6) AS skill FROM e WHERE before IS NOT NULL GROUP BY event_type HAVING count(*) >= 100""")
def skill_over_baseline(spark, sf_dir):
    """Persistence against the mean of its type, where 100 rows support it."""
    e = events(spark, sf_dir)
    usual = e.groupBy("event_type").agg(F.avg("value").alias("usual"))
    both = e.withColumn("before", F.lag("value").over(_series())).where("before is not null").join(F.broadcast(usual), "event_type")  # a row for each type
    mae = lambda c: F.avg(F.abs(F.col("value") - F.col(c)))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), r(1 - mae("before") / mae("usual")).alias("skill")).where("n >= 100")


@query("""SELECT round(regr_slope(mean, x), 6) AS slope, count(*) AS days, max(day) AS last_day FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS x
FROM events GROUP BY ALL ORDER BY day DESC LIMIT 7)""")
def slope_of_last_runs(spark, sf_dir):
    """The trend over the last seven days that have rows."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    last = days.orderBy(F.desc("day")).limit(7)
    return last.agg(r(F.regr_slope("mean", F.datediff("day", F.lit("2000-01-01").cast("date")))).alias("slope"), F.count("*").alias("days"), F.max("day").alias("last_day"))


@query(f"""WITH p AS (SELECT c_custkey, c_nationkey, (c_mktsegment = 'BUILDING')::INT AS y, {LAT.format('c_custkey')} AS lat, {LON.format('c_custkey')} AS lon FROM customer),
n AS (SELECT a.c_custkey, count(*) AS n, sum(b.y) AS s FROM p a JOIN p b ON a.c_nationkey <> b.c_nationkey AND {GREAT_CIRCLE.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15 GROUP BY a.c_custkey)
SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n, round((coalesce(s, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 1), 6) AS rate FROM p LEFT JOIN n USING (c_custkey)""")
def neighbor_other_group_rate(spark, sf_dir):
    """The smoothed rate of a label among neighbours of other groups."""
    own = place(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_nationkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), "lat", "lon")
    near = geo.other_groups(own, "c_nationkey", 15, {"n": F.lit(1), "s": F.col("y")}).drop("near")
    out = tables.dense_left(own, near, ["lat", "lon", "c_nationkey"])
    return out.select("c_custkey", "n", r((F.col("s") + 0.5) / (F.col("n") + 1)).alias("rate"))
