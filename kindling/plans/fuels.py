"""Fuel moisture states, rain in time, regimes and fuel formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions import fuels, weather
from kindling.functions.scores import RELIEF_MM, guarded_score, level
from kindling.operators import folds, ranks, scan, temporal
from kindling.operators.shared import dealt
from kindling.plans.common import events, r, registry, table
from kindling.plans.relations import RULE

QUERIES, ORACLES, query = registry()

EMC = "least(40.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN h <= 10 THEN 0.03::DOUBLE + 0.2626::DOUBLE * h - 0.00104::DOUBLE * h * t WHEN h <= 50 THEN 2.22::DOUBLE - 0.160::DOUBLE * h + 0.01660::DOUBLE * t ELSE 21.06::DOUBLE - 0.4944::DOUBLE * h + 0.005565::DOUBLE * h * h - 0.00063::DOUBLE * h * t END))"
HOURS = f"SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'purchase' THEN value / 50 ELSE 0 END AS p, {EMC} AS q FROM (SELECT *, least(value / 10, 40.0::DOUBLE) AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS h FROM events)"


def _hours(spark, sf_dir):
    q = weather.equilibrium_moisture(F.least(F.col("value") / 10, F.lit(40.0)), F.get_json_object("props", "$.k").cast("double"))
    return events(spark, sf_dir).select("user_id", "event_id", "value", "at", F.when(F.col("event_type") == "purchase", F.col("value") / 50).otherwise(0.0).alias("p"), q.alias("q"))


def _variant(name, rain):
    wet = f"(f.k + ({rain[0]}::DOUBLE - f.k) * (1.0::DOUBLE - exp(-d.p / {rain[1]}::DOUBLE)))" if rain else "f.k"
    return f"""f_{name} AS (SELECT user_id, 0::BIGINT AS n, 10.0::DOUBLE AS k FROM d WHERE n = 1 UNION ALL SELECT user_id, m, s + (q - s) * (1.0::DOUBLE - exp(CASE WHEN q < s THEN -1.0::DOUBLE / 10 ELSE -1.0::DOUBLE / 6 END))
FROM (SELECT d.user_id, d.n AS m, d.q, {wet} AS s FROM f_{name} f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1))"""


@query(f"""WITH RECURSIVE d AS ({HOURS}), {', '.join(_variant(n, v) for n, v in folds.RAIN_VARIANTS.items())}
SELECT d.event_id, {', '.join(f'round(f_{n}.k, 5) AS {n}' for n in folds.RAIN_VARIANTS)} FROM d {' '.join(f'JOIN f_{n} ON f_{n}.user_id = d.user_id AND f_{n}.n = d.n' for n in folds.RAIN_VARIANTS)}""")
def dead_fuel_rain_variants(spark, sf_dir):
    """Four variants of rain wetting, folded together in one pass."""
    steps = [folds.moisture(v) for v in folds.RAIN_VARIANTS.values()]
    both = lambda state, q, p: tuple(step((s,), q, p)[0] for step, s in zip(steps, state))
    out = folds.fold(_hours(spark, sf_dir), ["user_id"], ["event_id"], ["q", "p"], (10.0,) * 4, both, list(folds.RAIN_VARIANTS))
    return out.select("event_id", *(r(F.col(n), 5).alias(n) for n in folds.RAIN_VARIANTS))


@query(f"""WITH RECURSIVE d AS ({HOURS}), f AS (SELECT user_id, event_id, n, value, q AS a, q AS b, q AS c FROM d WHERE n = 1 UNION ALL SELECT user_id, event_id, n, value, CASE WHEN p > 0.5 THEN least(a + 0.5::DOUBLE * p, 40) ELSE a END, CASE WHEN p > 0.5 THEN least(b + 0.15::DOUBLE * p, 40) ELSE b END, CASE WHEN p > 0.5 THEN least(c + 0.05::DOUBLE * p, 40) ELSE c END
FROM (SELECT d.user_id, d.event_id, d.n, d.value, d.p, f.a + (d.q - f.a) * (1.0::DOUBLE - exp(-1.0::DOUBLE)) AS a, f.b + (d.q - f.b) * (1.0::DOUBLE - exp(-0.1::DOUBLE)) AS b, f.c + (d.q - f.c) * (1.0::DOUBLE - exp(-0.01::DOUBLE)) AS c FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1))
SELECT event_id, round(least(40, greatest(1, a + value / 8 - b)), 5) AS fm1, round(value / 8, 5) AS fm10, round(least(40, greatest(1, c + value / 8 - b)), 5) AS fm100 FROM f""")
def three_fuel_classes(spark, sf_dir):
    """Free-running 1, 10 and 100 hour fuels, all shifted by what sets the observed 10 hour fuel apart from the free one."""
    out = folds.fold(_hours(spark, sf_dir), ["user_id"], ["event_id"], ["q", "p", "value"], None, lambda s, q, p, _: folds.three_classes(s, q, p), ["a", "b", "c"])
    seen = F.col("value") / 8
    shifted = lambda c: r(weather.clip(F.col(c) + (seen - F.col("b")), folds.DRIEST, folds.WETTEST), 5)
    return out.select("event_id", shifted("a").alias("fm1"), r(seen, 5).alias("fm10"), shifted("c").alias("fm100"))


DAYS = "SELECT user_id, CAST(ts AS DATE) AS day, least(max(value) / 5, 45) AS t, avg(value) / 5 AS p FROM events GROUP BY ALL"


def _days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.least(F.max("value") / 5, F.lit(45.0)).alias("t"), (F.avg("value") / 5).alias("p"))


@query(f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM ({DAYS})), f AS (SELECT user_id, 0::BIGINT AS n, NULL::DATE AS day, 0.0::DOUBLE AS k FROM d WHERE n = 1 UNION ALL
SELECT user_id, m, e, least(800.0::DOUBLE, w + greatest(0, (800.0::DOUBLE - w) * (0.968::DOUBLE * exp(0.0486::DOUBLE * (t * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE)) - 8.30::DOUBLE) * 1e-3 / (1.0::DOUBLE + 10.88::DOUBLE * exp(-0.0441::DOUBLE * 1100 / 25.4::DOUBLE))))
FROM (SELECT d.user_id, d.n AS m, d.day AS e, d.t, greatest(0, f.k - greatest(0, d.p / 25.4::DOUBLE - 0.2::DOUBLE) * 100.0::DOUBLE) AS w FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1))
SELECT user_id, day, round(k / 100, 6) AS kbdi_inches, n > 90 AS valid FROM f WHERE n > 0""")
def kbdi_inches_ungated(spark, sf_dir):
    """The index in inches without the temperature gate; the first 90 rows of a station are spin-up."""
    out = scan.scanned(_days(spark, sf_dir), ["user_id"], [F.col("day")], scan.drought(1100.0, F.col("t"), F.col("p"), gate=False), F.lit(0.0), scan.clamp_both, scan.clamp, "k")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return out.select("user_id", "day", r(F.col("k") / 100).alias("kbdi_inches"), (place > folds.SPINUP_DAYS).alias("valid"))


@query(f"SELECT user_id, day, round(sum(greatest(0, t - 10)) OVER (PARTITION BY user_id ORDER BY day), 6) AS gdd, round(60 + least(1, greatest(0, (sum(greatest(0, t - 10)) OVER (PARTITION BY user_id ORDER BY day) - 200) / 800.0::DOUBLE)) * 60, 6) AS herbs FROM ({DAYS})")
def gdd_running_green(spark, sf_dir):
    """Degree-days without a reset, and the live moisture they give."""
    by = temporal.trailing(["user_id"], "day", rows=1 << 30)
    d = _days(spark, sf_dir).withColumn("gdd", F.sum(F.greatest(F.lit(0.0), F.col("t") - 10)).over(by))
    return d.select("user_id", "day", r(F.col("gdd")).alias("gdd"), r(fuels.live_moisture(F.col("gdd"), fuels.HERBS)).alias("herbs"))


RAIN = "SELECT *, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN value / 50 ELSE 0 END AS p, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9::DOUBLE, 1) AS hours FROM events"


def _rain(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("at", "event_id")
    hours = F.coalesce((F.col("at") - F.lag("at").over(by)) / 3.6e9, F.lit(1.0))
    return events(spark, sf_dir).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value") / 50).otherwise(0.0)).withColumn("hours", hours)


@query(f"""WITH a AS (SELECT *, sum((p > 0)::INT) OVER w AS i, sum((p = 0)::INT) OVER w AS j FROM ({RAIN}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN i = 0 THEN 999 ELSE least(999, sum(CASE WHEN p > 0 THEN 0 ELSE hours END) OVER (PARTITION BY user_id, i ORDER BY ts, event_id)) END, 6) AS since, round(CASE WHEN p > 0 THEN sum(CASE WHEN p > 0 THEN hours ELSE 0 END) OVER (PARTITION BY user_id, j ORDER BY ts, event_id) ELSE 0 END, 6) AS wet FROM a""")
def rain_age_and_spell(spark, sf_dir):
    """Hours since rain by interval, 999 at most and before the first; and hours of the wet spell that a row stands in."""
    run, hours = Window.partitionBy("user_id").orderBy("at", "event_id"), F.col("hours")
    a = _rain(spark, sf_dir).withColumn("i", F.sum((F.col("p") > 0).cast("int")).over(run)).withColumn("j", F.sum((F.col("p") == 0).cast("int")).over(run))
    upto = lambda k: Window.partitionBy("user_id", k).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    since = F.when(F.col("i") == 0, 999.0).otherwise(F.least(F.lit(999.0), F.sum(F.when(F.col("p") > 0, 0.0).otherwise(hours)).over(upto("i"))))
    wet = F.when(F.col("p") > 0, F.sum(F.when(F.col("p") > 0, hours).otherwise(0.0)).over(upto("j"))).otherwise(0.0)
    return a.select("event_id", r(since).alias("since"), r(wet).alias("wet"))


@query(f"""SELECT event_id, CAST(coalesce(n - max(CASE WHEN p > 0.1 THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS 23 PRECEDING), 24) AS INT) AS rows_back, round(CASE WHEN n >= 3 THEN sum(p) OVER (PARTITION BY user_id ORDER BY n ROWS 2 PRECEDING) ELSE 0 END, 6) AS p3, round(CASE WHEN n >= 24 THEN sum(p) OVER (PARTITION BY user_id ORDER BY n ROWS 23 PRECEDING) ELSE 0 END, 6) AS p24
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({RAIN}))""")
def rain_history_stack(spark, sf_dir):
    """Over a stack of 24 rows: rows back to rain, 24 without any, and sums that are 0 until the stack is long enough."""
    a = _rain(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")))
    by = Window.partitionBy("user_id").orderBy("n")
    last = F.max(F.when(F.col("p") > 0.1, F.col("n"))).over(by.rowsBetween(-23, 0))
    total = lambda k: r(F.when(F.col("n") >= k, F.sum("p").over(by.rowsBetween(1 - k, 0))).otherwise(0.0))
    return a.select("event_id", F.coalesce(F.col("n") - last, F.lit(24)).cast("int").alias("rows_back"), total(3).alias("p3"), total(24).alias("p24"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_quantity - lag(l_quantity) OVER w, 0), 6) AS dq, round(greatest(0, coalesce(l_tax - lag(l_tax) OVER w, 0)), 6) AS dp FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")
def lead_changes(spark, sf_dir):
    """Changes from one lead to the next within a run, 0 at the first; those of rain never negative."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    change = lambda c: F.coalesce(F.col(c) - F.lag(c).over(by), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(change("l_quantity")).alias("dq"), r(F.greatest(F.lit(0.0), change("l_tax"))).alias("dp"))


@query(f"""WITH a AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS dv, coalesce(value - lag(value) OVER (ORDER BY user_id, ts, event_id), 0) AS du FROM ({RAIN}))
SELECT event_id, CAST((p > 0)::INT - (dv < 0)::INT AS INT) AS grouped, CAST((p > 0)::INT - (du < 0)::INT AS INT) AS carried FROM a""")
def wet_dry_transition(spark, sf_dir):
    """Rain less drying, by station; and with the change carried over from one station's last row to the next one's first."""
    a = ranks.carried(_rain(spark, sf_dir).select("user_id", "at", "event_id", "value", "p"), [], ["user_id", "at", "event_id"], {"before": F.struct("user_id", "value")}, own=False)
    state = lambda v: ((F.col("p") > 0).cast("int") - (F.coalesce(F.col("value") - v, F.lit(0.0)) < 0).cast("int"))
    own = F.when(F.col("before.user_id") == F.col("user_id"), F.col("before.value"))
    return a.select("event_id", state(own).alias("grouped"), state(F.col("before.value")).alias("carried"))


WINDOWS = "(SELECT l_orderkey AS run, l_linenumber AS b, greatest(0, l_linenumber - 1 - l_partkey % 3) AS a, max(l_quantity) AS v FROM lineitem GROUP BY ALL UNION ALL SELECT l_orderkey, l_linenumber, 0, max(l_quantity) * 3 FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)"


@query(f"""WITH w AS (SELECT run, b, CAST(a AS INT) AS a, max(v) AS v FROM {WINDOWS} GROUP BY ALL), d AS (SELECT w.run, w.b, arg_max(greatest(0, w.v - q.v), w.a) AS v FROM w JOIN w q ON q.run = w.run AND q.a = w.a AND q.b = w.b - 1 GROUP BY ALL),
s AS (SELECT run, b, max(v) FILTER (a = b - 1) AS one, arg_max(v / greatest(1, b - a), a) AS spread FROM w GROUP BY ALL)
SELECT s.run, s.b AS lead, round(coalesce(one, d.v, spread), 6) AS mm FROM s LEFT JOIN d ON d.run = s.run AND d.b = s.b""")
def hourly_rain_of_mixed_windows(spark, sf_dir):
    """Rain of each hour from what sums a run has: the hour's own, else the difference of two that start together, else the shortest spread evenly."""
    lines = table(spark, sf_dir, "lineitem")
    t = lines.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("b"), F.greatest(F.lit(0), F.col("l_linenumber") - 1 - F.col("l_partkey") % 3).cast("int").alias("a"), F.col("l_quantity").alias("v"))
    w = dealt(t.unionByName(t.where("b > 3").withColumns({"a": F.lit(0), "v": F.col("v") * 3})), 2 * lines.count(), ["run"]).groupBy("run", "a", "b").agg(F.max("v").alias("v"))
    before = F.when(F.lag("b").over(by := Window.partitionBy("run", "a").orderBy("b")) == F.col("b") - 1, F.lag("v").over(by))
    w = w.withColumn("d", F.greatest(F.lit(0.0), F.col("v") - before)).withColumn("d", F.when(before.isNotNull(), F.col("d")))
    own, spread = F.max(F.when(F.col("a") == F.col("b") - 1, F.col("v"))), F.max_by(F.col("v") / F.greatest(F.lit(1), F.col("b") - F.col("a")), "a")
    differ = F.max_by("d", F.when(F.col("d").isNotNull(), F.col("a")))
    return w.groupBy("run", F.col("b").alias("lead")).agg(r(F.coalesce(own, differ, spread)).alias("mm"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 10 <> 0 THEN us END AS known FROM ({RAIN}))
SELECT event_id, round(CASE WHEN known IS NULL THEN by_rows ELSE by_time END, 6) AS p6 FROM (SELECT event_id, known, sum(p) OVER (PARTITION BY user_id ORDER BY n ROWS 5 PRECEDING) AS by_rows,
sum(CASE WHEN known IS NOT NULL THEN p END) OVER (PARTITION BY user_id, known IS NULL ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS by_time FROM a)""")
def rain_window_with_fallback(spark, sf_dir):
    """Rain of the last six hours; of the last six rows where a row has no time."""
    a = _rain(spark, sf_dir).withColumn("known", F.col("event_id") % 10 != 0)
    rows = F.sum("p").over(Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(-5, 0))
    time = F.sum("p").over(Window.partitionBy("user_id", "known").orderBy("at").rangeBetween(-6 * 3_600_000_000 + 1, 0))
    return a.select("event_id", r(F.when(F.col("known"), time).otherwise(rows)).alias("p6"))


@query(f"""WITH a AS (SELECT *, sum((p > 0)::INT) OVER w AS i FROM ({RAIN}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CASE WHEN i = 0 THEN 999 ELSE least(999, sum(CASE WHEN p > 0 THEN 0 ELSE hours END) OVER (PARTITION BY user_id, i ORDER BY ts, event_id)) END AS age, greatest(0, -coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)) / greatest(hours, 1) AS drying FROM a)
SELECT CASE WHEN p > 0.1 THEN 'active_rain' WHEN age <= 3 THEN 'post_rain' WHEN month(ts) IN (6, 7, 8) THEN 'summer_dry' ELSE 'other' END AS regime, count(*) AS n, round(avg(drying), 6) AS drying, round(avg(CASE WHEN hours > 0 THEN p / hours ELSE 0 END), 4) AS intensity, round(avg(ln(1 + p)), 6) AS log_rain FROM b GROUP BY 1""")
def rain_regimes(spark, sf_dir):
    """Regimes, the wettest first, with their drying rate, intensity and log of rain."""
    run = Window.partitionBy("user_id").orderBy("at", "event_id")
    a = _rain(spark, sf_dir).withColumn("i", F.sum((F.col("p") > 0).cast("int")).over(run)).withColumn("drying", F.greatest(F.lit(0.0), F.lag("value").over(run) - F.col("value")) / F.greatest(F.col("hours"), F.lit(1.0)))
    age = F.when(F.col("i") == 0, 999.0).otherwise(F.sum(F.when(F.col("p") > 0, 0.0).otherwise(F.col("hours"))).over(Window.partitionBy("user_id", "i").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    regime = F.when(F.col("p") > 0.1, "active_rain").when(F.col("age") <= 3, "post_rain").when(F.month("ts").isin(6, 7, 8), "summer_dry").otherwise("other")
    out = a.withColumn("age", age).groupBy(regime.alias("regime"))
    return out.agg(F.count("*").alias("n"), r(F.avg("drying")).alias("drying"), r(F.avg(F.when(F.col("hours") > 0, F.try_divide("p", "hours")).otherwise(0.0)), 4).alias("intensity"), r(F.avg(F.log1p("p"))).alias("log_rain"))


SCALED = "SELECT *, l_quantity / 3 AS fm, l_discount * 600 AS rh, l_tax * 400 AS w, l_quantity / 50 AS green FROM lineitem"
_part = lambda x: f"least(1, greatest(0, {x}))"


@query(f"""WITH a AS (SELECT *, {RULE} AS c FROM ({SCALED})), b AS (SELECT *, CASE c WHEN 2 THEN ({_part('(35 - rh) / 10')} + {_part('(w - 5) / 10')} + {_part('(9 - fm) / 9')}) / 3 WHEN 3 THEN ({_part('(25 - rh) / 5')} + {_part('(w - 15) / 10')} + {_part('(9 - fm) / 2')}) / 3
WHEN 4 THEN ({_part('(20 - rh) / 20')} + {_part('(w - 25) / 15')} + {_part('(7 - fm) / 7')}) / 3 ELSE 1 END AS share FROM a)
SELECT CAST(c AS INT) AS category, CAST(CASE WHEN c >= 2 AND share < green * 0.6::DOUBLE THEN c - 1 ELSE c END AS INT) AS dampened, count(*) AS n, round(avg(share), 6) AS share FROM b GROUP BY ALL""")
def seasonal_dampening(spark, sf_dir):
    """Classes lowered by one where they are only just reached and the season is green."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 3).alias("fm"), (F.col("l_discount") * 600).alias("rh"), (F.col("l_tax") * 400).alias("w"), (F.col("l_quantity") / 50).alias("green"))
    own = [F.col(c) for c in ("fm", "rh", "w")]
    x = x.withColumn("category", weather.danger_category(*own)).withColumn("share", fuels.severity(F.col("category"), *own))
    return x.groupBy("category", fuels.demoted(F.col("category"), F.col("share"), F.col("green"), 0.6).alias("dampened")).agg(F.count("*").alias("n"), r(F.avg("share")).alias("share"))


@query(f"""SELECT l_orderkey AS cell, CAST(max(CASE WHEN l_linenumber = 2 THEN -1 WHEN l_orderkey % 5 = 0 THEN 0 ELSE {RULE} END) AS INT) AS peak FROM ({SCALED}) GROUP BY l_orderkey""")
def peak_category_with_snow(spark, sf_dir):
    """The worst hour of each cell; missing hours are -1, and snow makes those that aren't missing low."""
    x = table(spark, sf_dir, "lineitem")
    c = weather.danger_category(F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 3), F.col("l_discount") * 600, F.col("l_tax") * 400)
    hourly = F.when(F.col("c").isNull(), -1).when(F.col("l_orderkey") % 5 == 0, 0).otherwise(F.col("c"))
    return x.withColumn("c", c).groupBy(F.col("l_orderkey").alias("cell")).agg(F.max(hourly).alias("peak"))


@query(f"""SELECT l_returnflag, CAST(CASE WHEN l_quantity / 3 < 5 OR l_discount * 600 < 20 OR l_tax * 200 * 2.237::DOUBLE > 25 THEN 4 WHEN l_quantity / 3 <= 7 OR l_discount * 600 <= 30 OR l_tax * 200 * 2.237::DOUBLE > 20 THEN 3 WHEN l_quantity / 3 <= 10 OR l_discount * 600 <= 35 OR l_tax * 200 * 2.237::DOUBLE > 15 THEN 2
WHEN l_quantity / 3 <= 15 OR l_discount * 600 <= 45 OR l_tax * 200 * 2.237::DOUBLE > 10 THEN 1 ELSE 0 END AS INT) AS level, count(*) AS n FROM lineitem GROUP BY ALL""")
def alert_level_variant(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy("l_returnflag", fuels.alert_level(F.col("l_quantity") / 3, F.col("l_discount") * 600, F.col("l_tax") * 200).alias("level")).agg(F.count("*").alias("n"))


CODES = list(fuels.FUEL_MODELS)
_table = "(VALUES " + ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, (a, b) in fuels.FUEL_MODELS.items()) + ") m(code, spread, intensity)"
_mult = "(1 + 6 * pow(tan(radians(least(45, greatest(0, l_tax * 800)))), 2)) * (1 + 0.06::DOUBLE * pow(greatest(0, l_quantity) * (1 - 0.85::DOUBLE * least(100, greatest(0, l_discount * 1000)) / 100), 1.5::DOUBLE))"


@query(f"""WITH x AS (SELECT *, ['{"', '".join([*CODES, "ZZ9"])}'][1 + l_partkey % {len(CODES) + 1}] AS code FROM lineitem) SELECT x.code, count(*) AS n, round(avg(spread * {_mult}), 4) AS spread, round(avg(intensity * {_mult}), 4) AS intensity FROM x LEFT JOIN {_table} ON m.code = x.code GROUP BY x.code""")
def spread_and_intensity(spark, sf_dir):
    """Relative spread and intensity of fuel models under slope, wind and canopy; null for a code that isn't known."""
    code = F.element_at(F.array(*map(F.lit, [*CODES, "ZZ9"])), (1 + F.col("l_partkey") % (len(CODES) + 1)).cast("int"))
    x = table(spark, sf_dir, "lineitem").withColumn("code", code)
    own = [F.col("l_tax") * 800, F.col("l_quantity"), F.col("l_discount") * 1000]
    return x.groupBy("code").agg(F.count("*").alias("n"), *(r(F.avg(fuels.fuel_index(F.col("code"), *own, k)), 4).alias(n) for k, n in enumerate(("spread", "intensity"))))


_relief = "CASE g WHEN 'grass' THEN 5.0 WHEN 'shrub' THEN 10.0 WHEN 'timber' THEN 18.0 ELSE 10.0 END"


@query(f"""SELECT g AS fuel_group, count(*) AS n, round(avg(least(1, greatest(0, l_quantity / 2 / ({_relief})::DOUBLE))), 6) AS relief FROM (SELECT *, CASE WHEN c IN (0, 91, 93, 98, 99) THEN 'nonburnable' WHEN c BETWEEN 101 AND 124 OR c BETWEEN 1 AND 3 THEN 'grass' WHEN c BETWEEN 141 AND 149 OR c BETWEEN 4 AND 7 THEN 'shrub'
WHEN c BETWEEN 161 AND 204 OR c BETWEEN 8 AND 13 THEN 'timber' ELSE 'unknown' END AS g FROM (SELECT *, l_partkey % 210 AS c FROM lineitem)) GROUP BY g""")
def fuel_group_relief(spark, sf_dir):
    """Fuel groups, and how far rain relieves each by its own threshold."""
    g = fuels.fuel_group((F.col("l_partkey") % 210).cast("double"))
    full = F.element_at(F.create_map(*(F.lit(x) for k, v in RELIEF_MM.items() for x in (k, v))), F.col("fuel_group"))
    x = table(spark, sf_dir, "lineitem").select(g.alias("fuel_group"), (F.col("l_quantity") / 2).alias("mm"))
    return x.groupBy("fuel_group").agg(F.count("*").alias("n"), r(F.avg(weather.clip(F.col("mm") / full, 0.0, 1.0))).alias("relief"))


_c01 = lambda x: f"least(1, greatest(0, {x}))"
_guard = f"""(CASE WHEN fm < 7 AND rh < 20 AND k >= 30 THEN 90 WHEN fm < 10 AND rh < 25 AND k >= 15 THEN 70 WHEN fm < 10 AND (rh < 45 OR k >= 10) THEN 50 WHEN fm >= 10 AND fm < 15 AND (rh < 60 OR k >= 6) THEN 30 WHEN fm >= 15 THEN 10 ELSE 0 END
+ CASE WHEN fm >= 10 AND fm < 15 AND (rh < 60 OR k >= 6) THEN ({_c01('(60 - rh) / 60')} + {_c01('k / 15')}) / 2 * 10 ELSE 0 END + CASE WHEN fm < 10 AND (rh < 45 OR k >= 10) THEN ({_c01('(45 - rh) / 45')} + {_c01('k / 20')}) / 2 * 10 ELSE 0 END
+ CASE WHEN fm < 10 AND rh < 25 AND k >= 15 THEN ({_c01('(25 - rh) / 25')} + {_c01('k / 30')} + {_c01('(10 - fm) / 10')}) / 3 * 10 ELSE 0 END + CASE WHEN fm < 7 AND rh < 20 AND k >= 30 THEN ({_c01('(20 - rh) / 20')} + {_c01('(k - 30) / 20')} + {_c01('(7 - fm) / 7')}) / 3 * 10 ELSE 0 END)"""


@query(f"""SELECT CAST((s >= 20)::INT + (s >= 40)::INT + (s >= 60)::INT + (s >= 80)::INT AS INT) AS level, count(*) AS n, round(avg(s), 5) AS mean FROM (SELECT least(100, greatest(0, CASE WHEN rain > 0.1 THEN greatest(s - least(20, greatest(0, rain * 20)), 10) ELSE s END)) AS s
FROM (SELECT *, {_guard} AS s FROM (SELECT coalesce(CASE WHEN l_linenumber <> 2 THEN l_quantity / 3 END, {EMC}) AS fm, h AS rh, l_tax * 400 * 0.868976::DOUBLE AS k, l_partkey % 7 / 5.0::DOUBLE AS rain FROM (SELECT *, l_quantity * 0.7::DOUBLE AS t, l_discount * 600 AS h FROM lineitem)))) GROUP BY 1""")
def continuous_danger_score(spark, sf_dir):
    """The score on 0 to 100 and its class; equilibrium moisture stands in where none was observed."""
    rh = F.col("l_discount") * 600
    fm = F.coalesce(F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 3), weather.equilibrium_moisture(F.col("l_quantity") * 0.7, rh))
    x = table(spark, sf_dir, "lineitem").select(fm.alias("fm"), rh.alias("rh"), (F.col("l_tax") * 400).alias("mph"), (F.col("l_partkey") % 7 / 5.0).alias("rain"))
    x = x.select(guarded_score(F.col("fm"), F.col("rh"), F.col("mph"), F.col("rain")).alias("s"))
    return x.groupBy(level(F.col("s"), [20.0, 40.0, 60.0, 80.0]).alias("level")).agg(F.count("*").alias("n"), r(F.avg("s"), 5).alias("mean"))


@query("""SELECT l_returnflag, round(avg(least(40, greatest(1, coalesce(p + (l_quantity / 3 - l_tax * 100), l_quantity / 3)))), 6) AS fm FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN l_discount * 200 END AS p FROM lineitem) GROUP BY l_returnflag""")
def anchored_moisture(spark, sf_dir):
    """Production moved by what sets a member apart from the control, within 1 to 40."""
    fm = fuels.anchored(F.col("l_quantity") / 3, F.col("l_tax") * 100, F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 200), 1.0, 40.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.avg(fm)).alias("fm"))
