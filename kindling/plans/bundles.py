"""Scores of fitted bundles, calibration, registries, manifests and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions import fuels, weather
from kindling.operators import metrics, ranks, tables
from kindling.operators.shared import dealt
from kindling.plans.common import events, place, r, registry, table
from kindling.plans.relations import RULE

QUERIES, ORACLES, query = registry()


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""WITH t AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(0 * l_tax) AS m0, stddev_samp(0 * l_tax) AS s0 FROM lineitem WHERE l_linenumber <= 4)
SELECT l_linenumber, round(avg((l_quantity - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS z, round(avg((0 * l_tax - m0) / CASE WHEN s0 = 0 THEN 1 ELSE s0 END), 6) AS flat FROM lineitem, t GROUP BY l_linenumber""")
def standardised(spark, sf_dir):
    """Scaled by the training rows; a column that doesn't vary is left at its distance from the mean."""
    x = _lines(spark, sf_dir).select("l_linenumber", F.col("l_quantity").alias("q"), (0 * F.col("l_tax")).alias("c"))
    t = x.where("l_linenumber <= 4").agg(*(f(c).alias(f"{n}_{c}") for c in "qc" for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))
    return x.join(F.broadcast(t)).groupBy("l_linenumber").agg(r(F.avg(z("q"))).alias("z"), r(F.avg(z("c"))).alias("flat"))  # one row


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS y, 0.2::DOUBLE + avg(value) / 60 AS lam FROM events GROUP BY ALL), m AS (SELECT month(day) AS month, quantile_cont(y - lam, 0.1) AS lo, quantile_cont(y - lam, 0.9) AS hi FROM d GROUP BY ALL)
SELECT user_id, day, round(lam, 8) AS lam, round(1 - exp(-lam), 8) AS p, round(greatest(0, lam + lo), 8) AS low, round(lam + hi, 8) AS high FROM d JOIN m ON m.month = month(day)""")
def rate_with_interval(spark, sf_dir):
    """Expected counts, the chance of one or more, and an interval from the month's residuals."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("y"), (0.2 + F.avg("value") / 60).alias("lam"))
    d = d.withColumn("month", F.month("day")).withColumn("e", F.col("y") - F.col("lam"))
    m = ranks.quantiles(d, ["month"], "e", {"lo": (0.1, "linear"), "hi": (0.9, "linear")})
    return d.join(F.broadcast(m), "month").select("user_id", "day", r(F.col("lam"), 8).alias("lam"), r(1 - F.exp(-F.col("lam")), 8).alias("p"), r(F.greatest(F.lit(0.0), F.col("lam") + F.col("lo")), 8).alias("low"), r(F.col("lam") + F.col("hi"), 8).alias("high"))  # twelve months


@query("""SELECT l_linenumber, round(avg(e), 6) AS elevated, round(avg(least(e, c)), 6) AS critical FROM (SELECT l_linenumber, CASE WHEN l_quantity <= 10 THEN l_quantity * 0.03 ELSE least(0.95, 0.3 + (l_quantity - 10) * 0.02) END AS e, CASE WHEN l_quantity <= 25 THEN 0.4 ELSE least(0.9, 0.4 + (l_quantity - 25) * 0.03) END AS c FROM lineitem) GROUP BY l_linenumber""")
def agreement_calibrated(spark, sf_dir):
    """Two calibrated chances, the rarer one never above the other."""
    q = F.col("l_quantity")
    e = F.when(q <= 10, q * 0.03).otherwise(F.least(F.lit(0.95), 0.3 + (q - 10) * 0.02))
    c = F.when(q <= 25, 0.4).otherwise(F.least(F.lit(0.9), 0.4 + (q - 25) * 0.03))
    return _lines(spark, sf_dir).groupBy("l_linenumber").agg(r(F.avg(e)).alias("elevated"), r(F.avg(F.least(e, c))).alias("critical"))


@query("""WITH x AS (SELECT l_linenumber AS lead, l_orderkey % 5 = 0 AS held, l_quantity - l_tax * 600 AS e FROM lineitem), o AS (SELECT avg(e) AS bias FROM x WHERE NOT held), b AS (SELECT lead, avg(e) * count(*) / (count(*) + 200) AS own FROM x WHERE NOT held GROUP BY lead),
s AS (SELECT avg(abs(e)) AS none, avg(abs(e - bias)) AS one, avg(abs(e - own)) AS each FROM x JOIN b USING (lead), o WHERE held) SELECT round(none, 6) AS none, round(one, 6) AS one, round(each, 6) AS each, CASE WHEN none <= one AND none <= each THEN 'none' WHEN one <= each THEN 'one' ELSE 'each' END AS chosen FROM s""")
def bias_chosen_by_validation(spark, sf_dir):
    """No offset, one, or one for each lead shrunk by its rows: whichever is best on rows held out."""
    x = _lines(spark, sf_dir).select(F.col("l_linenumber").alias("lead"), (F.col("l_orderkey") % 5 == 0).alias("held"), (F.col("l_quantity") - F.col("l_tax") * 600).alias("e"))
    fit = x.where("not held")
    b, o = fit.groupBy("lead").agg((F.avg("e") * F.count("*") / (F.count("*") + 200)).alias("own")), fit.agg(F.avg("e").alias("bias"))
    mae = lambda c: F.avg(F.abs(F.col("e") - c))
    s = x.where("held").join(F.broadcast(b), "lead").join(F.broadcast(o)).agg(mae(F.lit(0.0)).alias("none"), mae(F.col("bias")).alias("one"), mae(F.col("own")).alias("each"))  # a row for each lead, and one
    chosen = F.when((F.col("none") <= F.col("one")) & (F.col("none") <= F.col("each")), "none").when(F.col("one") <= F.col("each"), "one").otherwise("each")
    return s.select(*(r(F.col(c)).alias(c) for c in ("none", "one", "each")), chosen.alias("chosen"))


@query("""SELECT l.doc_id, round(pow(count(*) OVER (PARTITION BY d.source), -0.5::DOUBLE) * CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.6 END, 8) AS weight FROM labels l JOIN documents d USING (doc_id)""")
def group_size_weights(spark, sf_dir):
    """One over the root of the group's size, by provenance."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    n = x.groupBy("source").agg(F.count("*").alias("n"))
    return x.join(n, "source").select("doc_id", r(F.pow("n", F.lit(-0.5)) * F.when(F.col("quality") == 1, 1.0).otherwise(0.6), 8).alias("weight"))


@query("""WITH w AS (SELECT c_nationkey, avg(c_acctbal) / (SELECT avg(c_acctbal) FROM customer) AS m FROM customer GROUP BY ALL) SELECT c_custkey, round(least(0.95, greatest(0.01, 0.05::DOUBLE * CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE m END * (1 + c_custkey % 10 / 10.0::DOUBLE))), 6) AS p FROM customer JOIN w USING (c_nationkey)""")
def multiplier_blend(spark, sf_dir):
    """A base chance by the group's multiplier, 1 where there is none, and the weather's; within bounds."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    by = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).where("c_nationkey % 4 <> 0")
    both = c.join(by, "c_nationkey", "left").join(F.broadcast(c.agg(F.avg("c_acctbal").alias("all"))))  # one row
    p = 0.05 * F.coalesce(F.col("m") / F.col("all"), F.lit(1.0)) * (1 + F.col("c_custkey") % 10 / 10.0)
    return both.select("c_custkey", r(weather.clip(p, 0.01, 0.95)).alias("p"))


PROB = "SELECT round(1 / (1 + exp(-(l_quantity - 25) / 12)), 6) AS p, (l_extendedprice > 25000 + l_discount * 1e5)::INT AS y, l_returnflag AS grp FROM lineitem"


def _prob(spark, sf_dir):
    return _lines(spark, sf_dir).select(r(1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 12))).alias("p"), (F.col("l_extendedprice") > 25000 + F.col("l_discount") * 1e5).cast("int").alias("y"), F.col("l_returnflag").alias("grp"))


@query(f"""WITH x AS ({PROB}) SELECT CAST(k * 10 AS INT) AS percent, count(*) FILTER (p >= k / 10.0::DOUBLE) AS alarms, round(avg(y) FILTER (p >= k / 10.0::DOUBLE), 6) AS precision, round(coalesce(sum(y) FILTER (p >= k / 10.0::DOUBLE), 0) / sum(y)::DOUBLE, 6) AS recall FROM x, range(1, 10) t(k) GROUP BY k""")
def threshold_table(spark, sf_dir):
    """Precision and recall at nine thresholds, from counts by score."""
    levels = _prob(spark, sf_dir).groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    hit = lambda k: F.col("p") >= k / 10.0
    total = lambda c, k: F.coalesce(F.sum(F.when(hit(k), F.col(c))), F.lit(0))
    rows = [F.struct(F.lit(k * 10).alias("percent"), total("n", k).alias("alarms"), F.try_divide(total("pos", k), total("n", k)).alias("precision"), (total("pos", k) / F.sum("pos")).alias("recall")) for k in range(1, 10)]
    return levels.agg(F.array(*rows).alias("t")).select(F.explode("t").alias("t")).select("t.percent", "t.alarms", r(F.col("t.precision")).alias("precision"), r(F.col("t.recall")).alias("recall"))


@query(f"""WITH x AS ({PROB}), b AS (SELECT grp, avg(y) AS base FROM x GROUP BY grp), e AS (SELECT grp, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT grp, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM x GROUP BY grp, least(greatest(floor(p * 10), 0), 9)) GROUP BY grp)
SELECT x.grp, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(avg(y), 6) AS base_rate, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((base - y) * (base - y)), 6) AS climate, round(any_value(ece), 6) AS ece, sum(y) >= 20 AND count(*) - sum(y) >= 20 AS supported FROM x JOIN b ON b.grp = x.grp JOIN e ON e.grp = x.grp GROUP BY x.grp""")
def probability_block(spark, sf_dir):
    """By group: rows, events, base rate, Brier scores of forecast and climate, calibration error, and whether both outcomes are frequent enough to fit."""
    x = _prob(spark, sf_dir)
    p, y = F.col("p"), F.col("y")
    one = x.groupBy("grp").agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("events"), F.avg(y).alias("base_rate"), F.avg((p - y) * (p - y)).alias("brier"), F.var_pop(y).alias("climate"))
    bins = x.groupBy("grp", metrics.probability_bin(p).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    ece = bins.groupBy("grp").agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))
    ok = (F.col("events") >= 20) & (F.col("n") - F.col("events") >= 20)
    return one.join(ece, "grp").select("grp", "n", "events", *(r(F.col(c)).alias(c) for c in ("base_rate", "brier", "climate", "ece")), ok.alias("supported"))


@query("""WITH p AS (SELECT c_custkey AS k, -95 + (c_custkey * 53 % 600) / 100.0::DOUBLE AS lon, c_acctbal AS v FROM customer), m AS (SELECT median(lon) AS mid FROM p) SELECT CASE WHEN lon <= mid THEN 'west' ELSE 'east' END AS region, CASE WHEN k % 5 = 0 THEN 'held' ELSE 'train' END AS side, count(*) AS n, round(avg(v), 4) AS mean FROM p, m GROUP BY ALL""")
def region_and_station_splits(spark, sf_dir):
    """East and west of the median longitude, and stations held out."""
    x = place(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "lon", "c_acctbal")
    both = x.join(F.broadcast(ranks.quantiles(x, [], "lon", {"mid": (0.5, "linear")})))  # one row
    return both.groupBy(F.when(F.col("lon") <= F.col("mid"), "west").otherwise("east").alias("region"), F.when(F.col("c_custkey") % 5 == 0, "held").otherwise("train").alias("side")).agg(F.count("*").alias("n"), r(F.avg("c_acctbal"), 4).alias("mean"))


@query("""SELECT l_linenumber, round(avg(CASE WHEN m IS NULL THEN base ELSE base + greatest(-5, least(5, 0.4::DOUBLE * (m - base))) END), 6) AS fm, count(m) AS guarded FROM (SELECT l_linenumber, l_quantity / 3 AS base, CASE WHEN l_orderkey % 4 <> 0 THEN l_tax * 300 END AS m FROM lineitem) GROUP BY l_linenumber""")
def guarded_scoring(spark, sf_dir):
    """A capped share of a specialist's correction where it is available, the base elsewhere."""
    base, m = F.col("l_quantity") / 3, F.when(F.col("l_orderkey") % 4 != 0, F.col("l_tax") * 300)
    fm = F.coalesce(base + weather.clip(0.4 * (m - base), -5.0, 5.0), base)
    return _lines(spark, sf_dir).groupBy("l_linenumber").agg(r(F.avg(fm)).alias("fm"), F.count(m).alias("guarded"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_linenumber = 7 AND l_orderkey % 50 = 0) SELECT (SELECT count(*) FROM a) AS train, (SELECT count(*) FROM b) AS test, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_test""")
def manifest_disjointness(spark, sf_dir):
    """How many ids two sides of a split share."""
    x = _lines(spark, sf_dir)
    side = F.max(F.when(F.col("l_linenumber") == 1, 1)).alias("a"), F.max(F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 50 == 0), 1)).alias("b")
    k = x.groupBy("l_suppkey").agg(*side)
    return k.agg(F.count("a").alias("train"), F.count("b").alias("test"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("only_test"))


@query("""SELECT n_nationkey AS run, CAST(b AS VARCHAR) AS block, round(n_nationkey / 10.0::DOUBLE + b, 4) AS mae FROM nation, range(0, 3) t(b)""")
def nested_report_blocks(spark, sf_dir):
    """Blocks of metrics pulled from reports kept as JSON."""
    k = F.col("n_nationkey")
    blocks = F.map_from_entries(F.array(*(F.struct(F.lit(str(b)), F.struct((k / 10.0 + b).alias("mae"))) for b in range(3))))
    reports = table(spark, sf_dir, "nation").select(F.to_json(F.struct(k.alias("run"), F.struct(blocks.alias("by_lead")).alias("metrics"))).alias("j"))
    x = reports.select(F.from_json("j", "run INT, metrics STRUCT<by_lead: MAP<STRING, STRUCT<mae: DOUBLE>>>").alias("j"))
    return x.select("j.run", F.explode("j.metrics.by_lead").alias("block", "m")).select("run", "block", r(F.col("m.mae"), 4).alias("mae"))


@query("""WITH n AS (SELECT o_orderkey AS id, o_orderdate AS tm, o_orderkey % 2 = 0 AS updated FROM orders) SELECT id, updated, CAST(row_number() OVER (ORDER BY tm DESC, id DESC) AS INT) AS place FROM n QUALIFY place <= 200""")
def experiment_index(spark, sf_dir):
    """An index of experiments, updated by id, newest first, two hundred at most."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    x = tables.replace(o.withColumn("updated", F.lit(False)), o.where("id % 2 = 0").withColumn("updated", F.lit(True)), ["id"]).orderBy(F.desc("at"), F.desc("id")).limit(200)
    return x.select("id", "updated", F.row_number().over(Window.orderBy(F.desc("at"), F.desc("id"))).alias("place"))  # two hundred rows


@query("""SELECT side, count(*) AS n, round(avg(abs(v - m)), 6) AS model_mae, round(avg(abs(v - rh / 5)), 6) AS control_mae FROM (SELECT l_quantity AS v, l_tax * 600 AS m, l_discount * 1000 AS rh, CASE WHEN month(l_shipdate) = 12 THEN 'holdout' ELSE 'train' END AS side FROM lineitem) GROUP BY side""")
def against_fallback_control(spark, sf_dir):
    """A model against humidity over five, on both sides of a holdout."""
    e = lambda x: r(F.avg(F.abs(F.col("l_quantity") - x)))
    return _lines(spark, sf_dir).groupBy(F.when(F.month("l_shipdate") == 12, "holdout").otherwise("train").alias("side")).agg(F.count("*").alias("n"), e(F.col("l_tax") * 600).alias("model_mae"), e(F.col("l_discount") * 1000 / 5).alias("control_mae"))


@query("""SELECT cycle, n IS NOT NULL AS available FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-01-31 18:00:00', INTERVAL 6 HOUR)) AS cycle) LEFT JOIN (SELECT CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(6 * (o_orderkey % 4) AS INT)) AS c, count(*) AS n FROM orders GROUP BY ALL) ON c = cycle""")
def cycles_available(spark, sf_dir):
    """Cycles of six hours, and whether each has a run."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    cycles = spark.range(1).select(F.explode(F.sequence(ts("1996-01-01 00:00:00"), ts("1996-01-31 18:00:00"), F.expr("INTERVAL 6 HOURS"))).alias("cycle"))
    runs = table(spark, sf_dir, "orders").select((F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (6 * (F.col("o_orderkey") % 4)).cast("int"))).alias("cycle")).distinct().withColumn("has", F.lit(True))
    return cycles.join(runs, "cycle", "left").select("cycle", F.coalesce("has", F.lit(False)).alias("available"))


@query("""SELECT c_nationkey, code, round(canopy, 6) AS canopy FROM (SELECT * FROM (SELECT c_nationkey, c_custkey % 6 AS code, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, code) = 1) JOIN (SELECT c_nationkey, avg(c_acctbal) AS canopy FROM customer GROUP BY ALL) USING (c_nationkey)""")
def region_mode_and_mean(spark, sf_dir):
    """The most frequent code of a region, the smallest of equals, and the mean of another value; one pass over code counts."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 6).alias("code")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    return c.groupBy("c_nationkey").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"), r(F.sum("s") / F.sum("n")).alias("canopy"))


@query("""SELECT day, n, n = 0 AS gap, CASE WHEN n = 0 THEN 'fail' WHEN n < 3 THEN 'deferred' ELSE 'pass' END AS status FROM (SELECT c.day, count(DISTINCT o_custkey) AS n FROM (SELECT CAST(unnest(generate_series(DATE '1997-05-01', DATE '1997-07-31', INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN orders ON CAST(o_orderdate AS DATE) = c.day GROUP BY c.day)""")
def archive_readiness(spark, sf_dir):
    """Stations on each day of the archive, days without any included, and whether that is enough."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1997-05-01").cast("date"), F.lit("1997-07-31").cast("date"))).alias("day"))
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey")
    x = days.join(o, "day", "left").groupBy("day").agg(F.count_distinct("o_custkey").alias("n"))
    return x.select("day", "n", (F.col("n") == 0).alias("gap"), F.when(F.col("n") == 0, "fail").when(F.col("n") < 3, "deferred").otherwise("pass").alias("status"))


@query("""SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version, CAST(least(20, count(*)) AS BIGINT) AS kept, 'stable' AS kind FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, max(o_orderkey), count(*), 'beta' FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""")
def registry_listing(spark, sf_dir):
    """The newest version of each model with a history of twenty at most, and the betas beside it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate", "o_orderstatus")
    stable = o.groupBy("key").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"), F.least(F.lit(20), F.count("*")).cast("long").alias("kept")).withColumn("kind", F.lit("stable"))
    return stable.unionByName(o.where("o_orderstatus = 'P'").groupBy("key").agg(F.max("o_orderkey").alias("version"), F.count("*").alias("kept")).withColumn("kind", F.lit("beta")))


@query("""SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR), chr(10) ORDER BY o_orderkey)) AS hash, count(*) AS n FROM orders GROUP BY o_custkey""")
def row_key_hash(spark, sf_dir):
    """The hash of each manifest's sorted keys."""
    x = table(spark, sf_dir, "orders").groupBy("o_custkey")
    key = F.struct("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("k"))
    return x.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(key))["k"], "\n"), 256).alias("hash"), F.count("*").alias("n"))  # a manifest's keys


@query(f"""SELECT fm, rh, w, CAST({RULE} AS INT) AS category FROM (SELECT unnest([6.9, 7, 8.9, 9, 14.9, 15]::DOUBLE[]) AS fm), (SELECT unnest([19.9, 20, 24.9, 25, 34.9, 35, 44.9, 45]::DOUBLE[]) AS rh), (SELECT unnest([4.9, 5, 9.9, 10, 11.9, 12, 14.9, 15, 24.9, 25]::DOUBLE[]) AS w)""")
def rule_parity_at_boundaries(spark, sf_dir):
    """The rule at each of its boundaries and just below."""
    axis = lambda v, n: F.explode(F.array(*map(F.lit, map(float, v)))).alias(n)
    x = spark.range(1).select(axis([6.9, 7, 8.9, 9, 14.9, 15], "fm")).select("fm", axis([19.9, 20, 24.9, 25, 34.9, 35, 44.9, 45], "rh")).select("fm", "rh", axis([4.9, 5, 9.9, 10, 11.9, 12, 14.9, 15, 24.9, 25], "w"))
    return x.select("fm", "rh", "w", weather.danger_category(F.col("fm"), F.col("rh"), F.col("w")).alias("category"))


@query("""WITH s AS (SELECT l_linenumber, l_quantity / 50 AS score, l_returnflag = 'R' AS hit FROM lineitem), t AS (SELECT quantile_cont(score, 0.5) AS a, quantile_cont(score, 0.8) AS b, quantile_cont(score, 0.95) AS c FROM s), k AS (SELECT (score >= a)::INT + (score >= b)::INT + (score >= c)::INT AS level, hit FROM s, t)
SELECT CAST(level AS INT) AS level, count(*) AS n, round(avg(hit::INT), 6) AS rate, coalesce(avg(hit::INT) >= lag(avg(hit::INT)) OVER (ORDER BY level) - 1e-9, true) AS rises FROM k GROUP BY level""")
def calibrated_levels(spark, sf_dir):
    """Levels by percentiles of the score, their event rates, and whether these rise."""
    s = _lines(spark, sf_dir).select((F.col("l_quantity") / 50).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("hit"))
    t = ranks.quantiles(s, [], "score", {"a": (0.5, "linear"), "b": (0.8, "linear"), "c": (0.95, "linear")})
    k = s.join(F.broadcast(t)).groupBy(sum((F.col("score") >= F.col(c)).cast("int") for c in "abc").alias("level")).agg(F.count("*").alias("n"), F.avg("hit").alias("x"))  # one row
    rises = F.coalesce(F.col("x") >= F.lag("x").over(Window.orderBy("level")) - 1e-9, F.lit(True))  # four levels
    return k.select("level", "n", r(F.col("x")).alias("rate"), rises.alias("rises"))


@query("""SELECT user_id, round(avg(simple), 6) AS simple, round(avg(learned), 6) AS learned, round(avg(abs(simple - y)) - avg(abs(learned - y)), 6) AS gain FROM (SELECT user_id, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS simple, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS learned FROM events) WHERE simple IS NOT NULL GROUP BY user_id""")
def simple_against_learned(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("at", "event_id")
    x = events(spark, sf_dir).select("user_id", F.col("value").alias("y"), F.lag("value").over(by).alias("simple"), F.avg("value").over(by.rowsBetween(-3, -1)).alias("learned")).where("simple is not null")
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    return x.groupBy("user_id").agg(r(F.avg("simple")).alias("simple"), r(F.avg("learned")).alias("learned"), r(mae("simple") - mae("learned")).alias("gain"))


@query("""SELECT c_nationkey, count(*) AS days, round(sum(cases), 2) AS total, round(avg(cases), 4) AS mean FROM (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS cases FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) GROUP BY c_nationkey""")
def mean_of_every_number(spark, sf_dir):
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("cases"))
    return x.groupBy("c_nationkey").agg(F.count("*").alias("days"), r(F.sum("cases"), 2).alias("total"), r(F.avg("cases"), 4).alias("mean"))


@query("""SELECT k, fuel, CASE fuel WHEN 'grass' THEN 5.0 WHEN 'shrub' THEN 10.0 WHEN 'timber' THEN 18.0 ELSE 10.0 END::DOUBLE AS relief_mm FROM (SELECT c_custkey AS k, CASE WHEN n IN (0, 91, 93, 98, 99) THEN 'nonburnable' WHEN n BETWEEN 101 AND 124 OR n BETWEEN 1 AND 3 THEN 'grass' WHEN n BETWEEN 141 AND 149 OR n BETWEEN 4 AND 7 THEN 'shrub' WHEN n BETWEEN 161 AND 204 OR n BETWEEN 8 AND 13 THEN 'timber' ELSE 'unknown' END AS fuel FROM (SELECT c_custkey, c_custkey * 7 % 210 AS n FROM customer))""")
def fuel_threshold_grid(spark, sf_dir):
    """The rain that relieves each cell in full, by the fuel it holds."""
    from kindling.functions.scores import RELIEF_MM

    full = F.create_map(*(F.lit(x) for k, v in RELIEF_MM.items() for x in (k, v)))
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), fuels.fuel_group((F.col("c_custkey") * 7 % 210).cast("double")).alias("fuel"))
    return x.withColumn("relief_mm", F.element_at(full, F.col("fuel")))


@query()
def monte_carlo_categories(spark, sf_dir):
    """Chances of each class under correlated draws of moisture and humidity and lognormal wind, from a hundred seeded draws a row."""
    lines, keys = _lines(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    x = dealt(lines.select(*keys, (F.col("l_quantity") / 3).alias("fm"), (F.col("l_discount") * 600).alias("rh"), (F.col("l_tax") * 400).alias("w")), lines.count(), keys)  # draws are made where their row is counted
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(i), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "draw"), F.lit(1_000_003)) + 0.5) / 1_000_003
    normal = lambda i: F.sqrt(-2 * F.log(unit(i))) * F.cos(2 * 3.141592653589793 * unit(i + 100))
    d = x.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumns({"z1": normal(1), "z2": normal(2), "z3": normal(3)})
    c = weather.danger_category(F.greatest(F.lit(1.0), F.col("fm") + 1.5 * F.col("z1")), weather.clip(F.col("rh") + 5 * (0.6 * F.col("z1") + 0.8 * F.col("z2")), 0.0, 100.0), F.col("w") * F.exp(0.2 * F.col("z3")))
    n = d.withColumn("c", c).groupBy(*keys).agg(*(F.count_if(F.col("c").eqNullSafe(F.lit(k).cast("int"))).alias(f"n{k}") for k in (None, *range(5))))
    classes = F.array(*(F.struct((F.col(f"n{k}") / 100).alias("p"), F.lit(None if k is None else -k).cast("int").alias("m"), F.lit(k).cast("int").alias("c")) for k in (None, *range(5))))
    top = n.withColumn("top", F.array_max(F.filter(classes, lambda k: k["p"] > 0)))
    return top.select(*keys, F.col("top.c").alias("modal"), F.col("top.p").alias("stability"), ((F.col("n2") + F.col("n3") + F.col("n4")) / 100).alias("p_elevated"))
