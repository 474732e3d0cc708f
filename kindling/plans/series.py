"""Observations in time: dedup, as-of and tolerance joins, trailing windows, islands, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions.times import HOUR, hour_half_even, season_year
from kindling.functions.weather import equilibrium_moisture
from kindling.operators import folds, scan, tables, temporal
from kindling.plans.common import events, r, registry, table

QUERIES, ORACLES, query = registry()
ORDER = ["at", "event_id"]
HALF_HOUR = HOUR // 2


@query("""SELECT user_id, event_type, epoch_us(ts) // 3600000000 AS hour, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, epoch_us(ts) // 3600000000 ORDER BY ts DESC, event_id DESC) = 1""")
def obs_dedup_keep_last(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("hour", F.floor(F.col("at") / HOUR))
    return tables.last_per_key(rows, ["user_id", "event_type", "hour"], ORDER).select("user_id", "event_type", "hour", "event_id", "value")


@query("""SELECT event_type, count(*) AS n, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type""")
def json_props_parse(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg(k)).alias("mean_k"))


@query("""SELECT event_id, (CASE WHEN epoch_us(ts) % 3600000000 > 1800000000 OR (epoch_us(ts) % 3600000000 = 1800000000 AND (epoch_us(ts) // 3600000000) % 2 = 1)
THEN epoch_us(ts) // 3600000000 + 1 ELSE epoch_us(ts) // 3600000000 END) * 3600000000 AS hour_us FROM events""")
def hour_round_half_even(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hour_half_even(F.col("ts")).alias("hour_us"))


def _kind(spark, sf_dir, kind):
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "event_id", "at", "value")


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
c AS (SELECT p.event_id, v.event_id AS view_id, v.value AS view_value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS n
FROM p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts AND epoch_us(p.ts) - epoch_us(v.ts) <= 10800000000)
SELECT p.event_id, c.view_id, c.view_value FROM p LEFT JOIN c ON c.event_id = p.event_id AND c.n = 1""")
def asof_initial_max_age(spark, sf_dir):
    found = temporal.asof_backward(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "view"), ["user_id"], "at", "at", 3 * HOUR, ["event_id"])
    return found.select("event_id", F.col("r_event_id").alias("view_id"), F.col("r_value").alias("view_value"))


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), k AS (SELECT * FROM events WHERE event_type = 'click'),
c AS (SELECT e.event_id, k.event_id AS click_id, abs(epoch_us(k.ts) - epoch_us(e.ts)) AS gap_us, row_number() OVER (PARTITION BY e.event_id
ORDER BY abs(epoch_us(k.ts) - epoch_us(e.ts)), k.ts, k.event_id) AS n FROM e JOIN k ON k.user_id = e.user_id AND abs(epoch_us(k.ts) - epoch_us(e.ts)) <= 1800000000)
SELECT e.event_id, c.click_id, c.gap_us FROM e LEFT JOIN c ON c.event_id = e.event_id AND c.n = 1""")
def nearest_within_30min(spark, sf_dir):
    found = temporal.nearest_within(_kind(spark, sf_dir, "error"), _kind(spark, sf_dir, "click"), ["user_id"], "at", "at", HALF_HOUR, "event_id", ["event_id"])
    return found.select("event_id", F.col("r_event_id").alias("click_id"), F.abs(F.col("r_at") - F.col("at")).alias("gap_us"))


@query("""SELECT e.event_id, k.event_id AS click_id, epoch_us(k.ts) - epoch_us(e.ts) AS gap_us FROM events e JOIN events k ON k.user_id = e.user_id
AND abs(epoch_us(k.ts) - epoch_us(e.ts)) <= 1800000000 WHERE e.event_type = 'error' AND k.event_type = 'click'""")
def interval_all_matches(spark, sf_dir):
    pairs = temporal.within(_kind(spark, sf_dir, "error"), _kind(spark, sf_dir, "click"), ["user_id"], "at", "at", HALF_HOUR)
    return pairs.select("event_id", F.col("r_event_id").alias("click_id"), (F.col("r_at") - F.col("at")).alias("gap_us"))


@query("""WITH a AS (SELECT *, value - lag(value) OVER w AS d1, value - lag(value, 3) OVER w AS d3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(d1, 6) AS d1, round(d3, 6) AS d3, round(d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS accel,
round(coalesce(d1, 0), 6) AS d1_zero FROM a""")
def lag_diff_accel(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy(*ORDER)
    d = events(spark, sf_dir).withColumn("d1", F.col("value") - F.lag("value").over(by)).withColumn("d3", F.col("value") - F.lag("value", 3).over(by))
    return d.select("event_id", r(F.col("d1")).alias("d1"), r(F.col("d3")).alias("d3"), r(F.col("d1") - F.lag("d1").over(by)).alias("accel"), r(F.coalesce("d1", F.lit(0.0))).alias("d1_zero"))


@query("""SELECT event_id, round(avg(value) OVER (w ROWS 2 PRECEDING), 6) AS mean3, round(avg(value) OVER (w ROWS 5 PRECEDING), 6) AS mean6,
round(sum(value) OVER (w ROWS 23 PRECEDING), 4) AS sum24, round(CASE WHEN row_number() OVER w > 3 THEN avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END, 6) AS before3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def trailing_rows_mean_sum(spark, sf_dir):
    last = lambda n, skip=0: temporal.trailing(["user_id"], *ORDER, rows=n, skip=skip)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    return events(spark, sf_dir).select(
        "event_id", r(F.avg("value").over(last(3))).alias("mean3"), r(F.avg("value").over(last(6))).alias("mean6"), r(F.sum("value").over(last(24)), 4).alias("sum24"),
        r(F.when(place > 3, F.avg("value").over(last(3, 1)))).alias("before3"),
    )


@query("""WITH a AS (SELECT *, epoch_us(ts) AS us FROM events) SELECT event_id,
round(sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW), 4) AS sum3h,
round(sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), 4) AS sum6h,
round(sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 4) AS sum24h,
round(least(24.0, (us - min(us) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)) / 3600000000.0::DOUBLE + 1), 6) AS hours24 FROM a""")
def trailing_time_half_open(spark, sf_dir):
    span = lambda h: temporal.trailing_time(["user_id"], "at", h * HOUR)
    sums = [r(F.sum("value").over(span(h)), 4).alias(f"sum{h}h") for h in (3, 6, 24)]
    held = F.least(F.lit(24.0), (F.col("at") - F.min("at").over(span(24))) / float(HOUR) + 1)
    return events(spark, sf_dir).select("event_id", *sums, r(held).alias("hours24"))


DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total, max(value) AS top, avg(value) AS mean FROM events GROUP BY ALL"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.avg("value").alias("mean"))


@query(f"""SELECT user_id, day, round(coalesce(sum(total) OVER w, 0), 4) AS before3, count(total) OVER w AS rows3 FROM ({DAILY})
WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def antecedent_excl_current(spark, sf_dir):
    by = temporal.trailing(["user_id"], "day", rows=3, skip=1)
    return _daily(spark, sf_dir).select("user_id", "day", r(F.coalesce(F.sum("total").over(by), F.lit(0.0)), 4).alias("before3"), F.count("total").over(by).alias("rows3"))


@query("""WITH a AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) - (CASE WHEN i = 0 THEN 0 ELSE 1 END) AS rows_since FROM a""")
def hours_since_event_islands(spark, sf_dir):
    return temporal.since_event(events(spark, sf_dir), ["user_id"], ORDER, F.col("event_type") == "purchase", "rows_since").select("event_id", "rows_since")


@query("""SELECT event_id, round((rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY user_id), 6) AS pct FROM events""")
def percentile_rank_mean_ties(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r(temporal.mean_rank(["user_id"], "value")).alias("pct"))


@query("""WITH a AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, round(sum(greatest(coalesce(d, value), 0)), 4) AS total, count(*) FILTER (d < -1e-6) AS resets FROM a GROUP BY user_id""")
def cumulative_to_interval(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy(*ORDER)
    d = events(spark, sf_dir).select("user_id", "value", (F.col("value") - F.lag("value").over(by)).alias("d"))
    return d.groupBy("user_id").agg(r(F.sum(F.greatest(F.coalesce("d", "value"), F.lit(0.0))), 4).alias("total"), F.count_if(F.col("d") < -1e-6).alias("resets"))


@query(f"""WITH RECURSIVE d AS (SELECT user_id, day, least(top / 5, 45) AS t, mean / 5 AS p, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM ({DAILY})),
f AS (SELECT user_id, 0::BIGINT AS n, NULL::DATE AS day, 0.0::DOUBLE AS k FROM d WHERE n = 1 UNION ALL
SELECT d.user_id, d.n, d.day, least(800.0::DOUBLE, w + CASE WHEN d.t * 9.0 / 5.0 + 32.0 > 50 THEN greatest(0, (800.0::DOUBLE - w) * (0.968::DOUBLE * exp(0.0486::DOUBLE * (d.t * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE)) - 8.30::DOUBLE) * 1e-3
/ (1.0::DOUBLE + 10.88::DOUBLE * exp(-0.0441::DOUBLE * 1000 / 25.4::DOUBLE))) ELSE 0 END)
FROM (SELECT f.*, d.user_id AS u, d.n AS m, greatest(0, f.k - greatest(0, d.p / 25.4::DOUBLE - 0.2::DOUBLE) * 100.0::DOUBLE) AS w FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1) x JOIN d ON d.user_id = x.u AND d.n = x.m)
SELECT user_id, day, round(k * 0.254::DOUBLE, 4) AS kbdi_mm, n > 10 AS valid FROM f WHERE n > 0""")
def kbdi_fold(spark, sf_dir):
    days = _daily(spark, sf_dir).select("user_id", "day", F.least(F.col("top") / 5, F.lit(45.0)).alias("t"), (F.col("mean") / 5).alias("p"))
    out = scan.scanned(days, ["user_id"], [F.col("day")], scan.drought(1000.0, F.col("t"), F.col("p")), F.lit(0.0), scan.clamp_both, scan.clamp, "k")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return out.select("user_id", "day", r(F.col("k") * 0.254, 4).alias("kbdi_mm"), (place > 10).alias("valid"))  # a spin-up of 10 days


def _moist(rain: bool) -> str:
    state = "(f.k + (30.0::DOUBLE - f.k) * (1.0::DOUBLE - exp(-d.p / 2.0::DOUBLE)))" if rain else "f.k"
    return f"""WITH RECURSIVE d AS (SELECT user_id, event_id, least(value / 10, 40.0::DOUBLE) AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS h,
CASE WHEN event_type = 'purchase' THEN value / 50 ELSE 0 END AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT *, least(40.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN h <= 10 THEN 0.03::DOUBLE + 0.2626::DOUBLE * h - 0.00104::DOUBLE * h * t WHEN h <= 50 THEN 2.22::DOUBLE - 0.160::DOUBLE * h + 0.01660::DOUBLE * t
ELSE 21.06::DOUBLE - 0.4944::DOUBLE * h + 0.005565::DOUBLE * h * h - 0.00063::DOUBLE * h * t END)) AS q FROM d),
f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 10.0::DOUBLE AS k FROM d WHERE n = 1 UNION ALL
SELECT x.user_id, x.m, x.e, x.s + (x.q - x.s) * (1.0::DOUBLE - exp(CASE WHEN x.q < x.s THEN -1.0::DOUBLE / 10 ELSE -1.0::DOUBLE / 6 END))
FROM (SELECT d.user_id, d.n AS m, d.event_id AS e, d.q, {state} AS s FROM f JOIN e d ON d.user_id = f.user_id AND d.n = f.n + 1) x)
SELECT event_id, round(k, 5) AS fm FROM f WHERE n > 0"""


def _moisture(spark, sf_dir, rain):
    rows = events(spark, sf_dir).select(
        "user_id", "event_id", equilibrium_moisture(F.least(F.col("value") / 10, F.lit(40.0)), F.get_json_object("props", "$.k").cast("double")).alias("q"), F.when(F.col("event_type") == "purchase", F.col("value") / 50).otherwise(0.0).alias("p")
    )
    out = folds.fold(rows, ["user_id"], ["event_id"], ["q", "p"], (10.0,), folds.moisture((30.0, 2.0) if rain else None), ["k"])
    return out.select("event_id", r(F.col("k"), 5).alias("fm"))


@query(_moist(False))
def dead_fuel_fold(spark, sf_dir):
    return _moisture(spark, sf_dir, False)


@query(_moist(True))
def dead_fuel_rain_fold(spark, sf_dir):
    return _moisture(spark, sf_dir, True)


@query("""WITH d AS (SELECT c_nationkey AS region, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 10000 AS t FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT region, day, round(sum(greatest(0, t - 10)) OVER (PARTITION BY region, year(day) - (CASE WHEN month(day) < 3 THEN 1 ELSE 0 END) ORDER BY day), 8) AS gdd FROM d""")
def gdd_season_accum(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    days = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("region"), F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 10000).alias("t"))
    by = Window.partitionBy("region", season_year(F.col("day"))).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("region", "day", r(F.sum(F.greatest(F.lit(0.0), F.col("t") - 10)).over(by), 8).alias("gdd"))


@query("""WITH m AS (SELECT month(ts) AS month, hour(ts) // 6 AS part, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY ALL), o AS (SELECT avg(value) AS v FROM events WHERE user_id % 2 = 0)
SELECT CAST(hour(ts) // 6 AS BIGINT) AS part, count(*) AS n, round(avg(abs(e.value - coalesce(m.v, o.v))), 6) AS mae FROM events e CROSS JOIN o LEFT JOIN m ON m.month = month(e.ts) AND m.part = hour(e.ts) // 6
WHERE e.user_id % 2 = 1 GROUP BY ALL""")
def seasonal_baseline(spark, sf_dir):
    """Means by month and quarter day of one half of the stations, the overall mean where there is none, held against the other half."""
    rows = table(spark, sf_dir, "events").withColumns({"month": F.month("ts"), "part": F.floor(F.hour("ts") / 6)})
    half = rows.where("user_id % 2 = 0")
    means = half.groupBy("month", "part").agg(F.avg("value").alias("v"))
    overall = half.agg(F.avg("value").alias("o"))
    found = rows.where("user_id % 2 = 1").join(means, ["month", "part"], "left").join(F.broadcast(overall))  # one row
    return found.groupBy("part").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("value") - F.coalesce("v", "o")))).alias("mae"))


@query(f"""SELECT user_id, datediff('day', min(day), max(day)) + 1 - count(DISTINCT day) AS gap_days, count(DISTINCT day) AS days FROM ({DAILY}) GROUP BY user_id""")
def coverage_gap_report(spark, sf_dir):
    d = _daily(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("day").alias("days"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    return d.select("user_id", (F.col("span") + 1 - F.col("days")).alias("gap_days"), "days")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN value < 1 THEN 'low' WHEN value > 200 THEN 'high' WHEN CAST(json_extract_string(props, '$.k') AS INT) < 3 THEN 'props'
WHEN row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) > 1 THEN 'duplicate' ELSE 'ok' END AS reason FROM events) GROUP BY reason""")
def qc_first_reason(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    checks = {"low": F.col("value") < 1, "high": F.col("value") > 200, "props": F.get_json_object("props", "$.k").try_cast("int") < 3}
    return rows.select(tables.first_reason(checks, ["user_id", "event_type", "day"], ["event_id"]).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, avg(value) AS rh, max(value) / 4 AS wind, min(value) / 6 AS fm FROM (SELECT * FROM events QUALIFY row_number() OVER
(PARTITION BY user_id, event_type, epoch_us(ts) // 3600000000 ORDER BY ts DESC, event_id DESC) = 1) GROUP BY ALL),
c AS (SELECT user_id, CASE WHEN fm >= 15 THEN 0 WHEN fm < 7 AND rh < 20 AND wind >= 25 THEN 4 WHEN fm < 9 AND rh < 25 AND wind >= 15 THEN 3 WHEN fm < 9 AND ((rh < 35 AND wind >= 12) OR (rh < 25 AND wind >= 5)) THEN 2
WHEN rh < 45 OR wind >= 10 THEN 1 ELSE 0 END AS k, round(avg(rh) OVER (PARTITION BY user_id ORDER BY hour ROWS 2 PRECEDING), 6) AS rh3 FROM h)
SELECT user_id, count(*) AS hours, CAST(max(k) AS INT) AS worst, count(*) FILTER (k >= 2) AS elevated, round(avg(rh3), 4) AS mean_rh3 FROM c GROUP BY user_id""")
def station_danger_summary(spark, sf_dir):
    """From observations to hourly categories to a row per station."""
    from kindling.functions.weather import danger_category

    rows = tables.last_per_key(events(spark, sf_dir).withColumn("hour", F.floor(F.col("at") / HOUR)), ["user_id", "event_type", "hour"], ORDER)
    hours = rows.groupBy("user_id", "hour").agg(F.avg("value").alias("rh"), (F.max("value") / 4).alias("wind"), (F.min("value") / 6).alias("fm"))
    hours = hours.withColumn("k", danger_category(F.col("fm"), F.col("rh"), F.col("wind"))).withColumn("rh3", r(F.avg("rh").over(temporal.trailing(["user_id"], "hour", rows=3))))
    return hours.groupBy("user_id").agg(F.count("*").alias("hours"), F.max("k").alias("worst"), F.count_if(F.col("k") >= 2).alias("elevated"), r(F.avg("rh3"), 4).alias("mean_rh3"))
