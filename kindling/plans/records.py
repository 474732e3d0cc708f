"""Filters, orders, sets, stores and small reports over tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions import fuels, times, weather
from kindling.operators import metrics, ranks, splits, tables
from kindling.plans.common import events, r, registry, table

QUERIES, ORACLES, query = registry()


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END AS a, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END AS b FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL AND l_quantity BETWEEN 5 AND 45 GROUP BY l_returnflag""")
def drop_null_and_out_of_range(spark, sf_dir):
    x = _lines(spark, sf_dir).withColumns({"a": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")), "b": F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount"))})
    return x.na.drop(subset=["a", "b"]).where(F.col("l_quantity").between(5, 45)).groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("total"))


@query("""SELECT count(*) FILTER (NOT coalesce(kind IN ('click', 'view'), false)) AS kept, count(*) FILTER (kind IN ('click', 'view')) AS excluded, count(*) FILTER (kind IS NULL) AS unnamed FROM (SELECT nullif(event_type, 'purchase') AS kind FROM events)""")
def exclusion_list(spark, sf_dir):
    """Rows on a list go; a row without a name is on none."""
    x = table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("purchase")).alias("kind"))
    out = F.coalesce(F.col("kind").isin("click", "view"), F.lit(False))
    return x.agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("excluded"), F.count_if(F.col("kind").isNull()).alias("unnamed"))


@query("""SELECT o_orderpriority AS tier, count(*) AS n FROM orders WHERE o_orderpriority >= '2' GROUP BY o_orderpriority""")
def tier_filter_checked(spark, sf_dir):
    """Rows of the accepted tiers; the query fails if their number isn't the manifest's."""
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("n"))
    told = x.agg(F.sum(F.when(F.col("tier") >= "2", F.col("n"))).alias("told"))  # what a manifest would state
    kept = x.where("tier >= '2'").withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0)))).join(F.broadcast(told))  # one row
    checked = F.when(F.col("all") == F.col("told"), F.col("n")).otherwise(F.raise_error(F.lit("rows and manifest differ")).cast("long"))
    return kept.select("tier", checked.alias("n"))


@query("""SELECT l_linenumber, round(avg(CASE WHEN isfinite(x) THEN x END), 6) AS mean, count(*) FILTER (x IS NULL OR NOT isfinite(x)) AS void FROM (SELECT l_linenumber, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_discount END AS x FROM lineitem) GROUP BY l_linenumber""")
def finite_or_null(spark, sf_dir):
    x = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") != 0, F.try_divide("l_quantity", "l_discount"))
    x = _lines(spark, sf_dir).select("l_linenumber", x.alias("x")).withColumn("x", tables.finite(F.col("x")))
    return x.groupBy("l_linenumber").agg(r(F.avg("x")).alias("mean"), F.count_if(F.col("x").isNull()).alias("void"))


@query("""SELECT event_id, round(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (ORDER BY user_id, ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS filled FROM events""")
def forward_fill_over_all(spark, sf_dir):
    """The last value before, in the order of stations and times, over the ends of stations too."""
    seen = F.when(F.col("event_type") == "view", F.col("value"))
    return ranks.carried(events(spark, sf_dir).select("user_id", "at", "event_id", "event_type", "value"), [], ["user_id", "at", "event_id"], {"filled": seen}).select("event_id", r(F.col("filled")).alias("filled"))


@query("""SELECT count(*) AS n, count(*) FILTER (o_custkey % 7 = 3) AS refused FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1998-01-01'""")
def since_and_forbidden(spark, sf_dir):
    """Rows of a range of dates, pruned at the scan, and how many carry an id that may not appear."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    x = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= at("1996-03-01")) & (F.col("o_orderdate") < at("1998-01-01")))
    forbidden = table(spark, sf_dir, "customer").where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("o_custkey"))
    marked = x.join(forbidden.withColumn("bad", F.lit(True)), "o_custkey", "left")
    return marked.agg(F.count("*").alias("n"), F.count_if("bad").alias("refused"))


RANKS = ["HOUSEHOLD", "MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE"]


@query(f"""SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY list_position({RANKS}, c_mktsegment), round(c_acctbal) DESC NULLS LAST, c_custkey) AS INT) AS place FROM customer QUALIFY place <= 50""")
def ladder_top(spark, sf_dir):
    """The first fifty in a rank order of one's own, then falling with nulls last, then by key."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("c_mktsegment"))
    top = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", rank.alias("k"), F.round("c_acctbal").alias("b")).orderBy("k", F.col("b").desc_nulls_last(), "c_custkey").limit(50)
    return top.select("c_custkey", "c_mktsegment", F.row_number().over(Window.orderBy("k", F.col("b").desc_nulls_last(), "c_custkey")).alias("place"))  # fifty rows


@query("""SELECT vec_id, CAST((i - 1) // 8 AS INT) AS "row", CAST((i - 1) % 8 AS INT) AS col, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, range(1, 4096) t(i) WHERE i <= len(embedding) AND (i - 1) // 8 % 4 = 0 AND (i - 1) % 8 % 4 = 0""")
def thinned_panel(spark, sf_dir):
    """Every fourth row and column of each day's grid, long."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), r(F.col("v").cast("double")).alias("value"))
    return cells.where("row % 4 = 0 AND col % 4 = 0")


@query("""SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, min(o_orderkey) >= 0 AS known FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)""")
def seeded_sample(spark, sf_dir):
    """A hundred rows drawn by the hash of key and seed: the same rows at each run."""
    draw = table(spark, sf_dir, "orders").orderBy(F.xxhash64(F.lit(417), "o_orderkey"), "o_orderkey").limit(100)
    return draw.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), (F.min("o_orderkey") >= 0).alias("known"))


@query("""SELECT kind, count(*) AS n, count(a) AS a, count(b) AS b FROM (SELECT 'order' AS kind, o_totalprice AS a, NULL AS b FROM orders UNION ALL SELECT 'line', NULL, l_quantity FROM lineitem) GROUP BY kind""")
def union_aligned(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("a"))
    both = a.unionByName(_lines(spark, sf_dir).select(F.lit("line").alias("kind"), F.col("l_quantity").alias("b")), allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b"))


@query("""SELECT l_returnflag, round(avg(sqrt(u * u + v * v)), 6) AS speed, round(avg(sqrt(u * u + v * v) * 1.9438444924406::DOUBLE * 0.8::DOUBLE), 6) AS knots, round(avg((degrees(atan2(l_tax - 0.04::DOUBLE, l_discount - 0.05::DOUBLE)) + 360) % 360), 5) AS aspect, round(avg(CASE WHEN k > 150 THEN k - 273.15::DOUBLE ELSE k END), 6) AS celsius, round(avg(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END), 5) AS lon
FROM (SELECT *, l_quantity - 25 AS u, l_tax * 100 AS v, l_quantity * 10 AS k, l_partkey % 360 AS lon FROM lineitem) GROUP BY l_returnflag""")
def wind_aspect_units(spark, sf_dir):
    u, v = F.col("l_quantity") - 25, F.col("l_tax") * 100
    speed = weather.wind_speed(u, v)
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(
        r(F.avg(speed)).alias("speed"), r(F.avg(speed * weather.KNOTS_PER_MS * weather.FIRE_WIND)).alias("knots"), r(F.avg(weather.aspect_degrees(F.col("l_tax") - 0.04, F.col("l_discount") - 0.05)), 5).alias("aspect"),
        r(F.avg(weather.celsius(F.col("l_quantity") * 10))).alias("celsius"), r(F.avg(weather.lon180(F.col("l_partkey") % 360)), 5).alias("lon"),
    )


@query("""WITH q AS (SELECT quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lineitem) SELECT CAST((l_quantity > e[2])::INT + (l_quantity > e[3])::INT + (l_quantity > e[4])::INT + (l_quantity > e[5])::INT AS INT) AS quintile, count(*) AS n FROM lineitem, q GROUP BY 1""")
def quintile_labels(spark, sf_dir):
    """Fifths by value, closed on the right."""
    x = _lines(spark, sf_dir)
    edges = ranks.quantiles(x, [], "l_quantity", {f"e{p}": (p / 5, "linear") for p in range(1, 5)})
    label = sum((F.col("l_quantity") > F.col(f"e{p}")).cast("int") for p in range(1, 5))
    return x.join(F.broadcast(edges)).groupBy(label.alias("quintile")).agg(F.count("*").alias("n"))  # one row


@query("""SELECT day, round(sin(2 * pi() * (dayofyear(day) - 1) / 365.2425::DOUBLE), 6) AS gregorian, round(cos(2 * pi() * dayofyear(day) / 365.25::DOUBLE), 6) AS julian, CAST((month(day) = 2)::INT AS INT) AS m2, CAST((month(day) = 12)::INT AS INT) AS m12 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""")
def cyclic_conventions(spark, sf_dir):
    """The two other conventions of a day's place in the year, and dummies of months."""
    day = F.col("day")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", r(F.sin(times.turn(day, 365.2425, 1))).alias("gregorian"), r(F.cos(times.turn(day, 365.25, 0))).alias("julian"), *(m.alias(f"m{i}") for i, m in times.month_dummies(day).items() if i in (2, 12)))


@query("""SELECT grp, count(*) AS n, min(start) AS first FROM (SELECT CASE WHEN w < 12 THEN 'day1_3' WHEN w < 20 THEN 'day4_5' ELSE 'day6_7' END AS grp, o_orderdate + to_hours(CAST(6 * w AS INT)) AS start FROM (SELECT o_orderdate, o_orderkey % 28 AS w FROM orders)) GROUP BY grp""")
def lead_groups(spark, sf_dir):
    """Six-hour windows 0 to 27 in three groups of leads, and where each begins."""
    w = (F.col("o_orderkey") % 28).cast("int")
    grp = F.when(w < 12, "day1_3").when(w < 20, "day4_5").otherwise("day6_7")
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), 6 * w)
    return table(spark, sf_dir, "orders").select(grp.alias("grp"), start.alias("start")).groupBy("grp").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query("""SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || '|' || c_mktsegment AS key, count(*) AS n, CAST(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) AS BIGINT) AS last FROM customer GROUP BY 1""")
def padded_keys(spark, sf_dir):
    key = F.concat_ws("|", F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), "c_mktsegment")
    return table(spark, sf_dir, "customer").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.max(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long")).alias("last"))


@query("""SELECT n_nationkey, v.major || '.' || (v.minor + 1) || '.0' AS next_minor, v.major || '.' || v.minor || '.' || (v.patch + 1) || '-beta.' || (CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 1 END) AS next_beta FROM (SELECT n_nationkey, {major: n_nationkey % 3, minor: n_nationkey % 5, patch: n_nationkey % 7} AS v FROM nation)""")
def next_versions(spark, sf_dir):
    """The next minor version, and the next beta of a patch, counted on where one exists."""
    k = F.col("n_nationkey")
    text = lambda patch: F.concat_ws(".", (k % 3).cast("string"), (k % 5).cast("string"), patch.cast("string"))
    beta = F.when(k % 2 == 0, F.concat(text(k % 7 + 1), F.lit("-beta.3"))).otherwise(text(k % 7))
    stable = text(k % 7)
    return table(spark, sf_dir, "nation").select("n_nationkey", fuels.next_version(stable, "minor").alias("next_minor"), fuels.next_version(stable, "patch", beta).alias("next_beta"))


@query("""WITH d AS (SELECT code, CAST(row_number() OVER (ORDER BY code) AS INT) AS n FROM (SELECT DISTINCT p_size AS code FROM part WHERE p_size % 4 <> 0)) SELECT coalesce(n, 0) AS code, count(*) AS n FROM part LEFT JOIN d ON d.code = p_size GROUP BY 1""")
def category_codes(spark, sf_dir):
    """Codes 1 to n in the order of the values, 0 where there is none; distinct codes reach the window."""
    x = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("v"))
    codes = x.where("v is not null").distinct().select("v", F.row_number().over(Window.orderBy("v")).alias("c"))
    return x.join(codes, "v", "left").groupBy(F.coalesce("c", F.lit(0)).alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber, round_even(avg(abs(l_quantity - l_tax * 600)), 4) AS mae, round_even(sum(l_quantity) / 8, 0) AS eighth FROM lineitem GROUP BY l_linenumber""")
def half_even_metrics(spark, sf_dir):
    """Rounded to even, as the reports are."""
    return _lines(spark, sf_dir).groupBy("l_linenumber").agg(F.bround(F.avg(F.abs(F.col("l_quantity") - F.col("l_tax") * 600)), 4).alias("mae"), F.bround(F.sum("l_quantity") / 8, 0).alias("eighth"))


@query("""WITH o AS (SELECT 1 AS id, 'old' AS title, 7 AS n), w AS (SELECT 1 AS id, CAST(NULL AS VARCHAR) AS title, count(*) AS n FROM nation) SELECT w.id, coalesce(w.title, o.title) AS title, coalesce(w.n, o.n) AS n FROM w JOIN o USING (id)""")
def singleton_partial_update(spark, sf_dir):
    """A table of one row; what a change leaves null stays."""
    old = spark.range(1).select(F.lit(1).alias("id"), F.lit("old").alias("title"), F.lit(7).cast("long").alias("n"))
    new = table(spark, sf_dir, "nation").agg(F.count("*").alias("n")).select(F.lit(1).alias("id"), F.lit(None).cast("string").alias("title"), "n")
    return tables.partial_update(old, new, ["id"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN -1 ELSE o_totalprice END AS o_totalprice FROM orders""")
def partial_update_by_key(spark, sf_dir):
    old, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    new = old.where(k % 4 == 0).select("o_orderkey", F.lit("Z").alias("o_orderstatus"), F.when(k % 8 == 0, -1.0).alias("o_totalprice"))
    return tables.partial_update(old, new, ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM orders UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 1""")
def insert_or_replace(spark, sf_dir):
    old, k = table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey")
    new = old.where(k % 3 == 0).unionByName(old.where(k % 100 == 1).select((-k).alias("o_orderkey"))).withColumn("source", F.lit("new"))
    return tables.replace(old.withColumn("source", F.lit("old")), new, ["o_orderkey"])


@query("""SELECT o_orderpriority, count(*) AS n, max(o_orderkey) + 1 AS next_id, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 400 DAY >= DATE '1998-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY o_orderpriority""")
def active_and_next_id(spark, sf_dir):
    """What is active and hasn't expired, with the id that comes next."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    live = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < now) & (F.col("o_orderdate") >= now - F.expr("INTERVAL 400 DAYS")))
    return live.groupBy("o_orderpriority").agg(F.count("*").alias("n"), (F.max("o_orderkey") + 1).alias("next_id"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT processed, count(*) AS n FROM (SELECT CASE WHEN o_orderdate >= DATE '1997-01-01' THEN false ELSE true END AS processed FROM orders) GROUP BY processed""")
def reset_flags(spark, sf_dir):
    """The processed flag set back from a date on."""
    x = table(spark, sf_dir, "orders").select((F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("processed"))
    return x.groupBy("processed").agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(o_totalprice), 4) AS mean_price FROM events e JOIN customer ON c_custkey = user_id JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL) o ON o_custkey = c_custkey AND dayofyear(o.day) = dayofyear(CAST(e.ts AS DATE)) GROUP BY c_nationkey""")
def training_set_join(spark, sf_dir):
    """Observations by station and day of the year with what was known then, over three inner joins."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "value", F.dayofyear("ts").alias("doy"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("o_totalprice"))
    both = e.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(o.withColumn("doy", F.dayofyear("day")), ["c_custkey", "doy"])
    return both.groupBy("c_nationkey").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean_value"), r(F.avg("o_totalprice"), 4).alias("mean_price"))


def _half(kind):
    return f"SELECT user_id, (CASE WHEN epoch_us(ts) % 3600000000 > 1800000000 OR (epoch_us(ts) % 3600000000 = 1800000000 AND (epoch_us(ts) // 3600000000) % 2 = 1) THEN epoch_us(ts) // 3600000000 + 1 ELSE epoch_us(ts) // 3600000000 END) * 3600000000 AS hour, avg(value) AS v FROM events WHERE event_type = '{kind}' GROUP BY ALL"


@query(f"SELECT a.user_id, a.hour, round(a.v - b.v, 6) AS error FROM ({_half('view')}) a JOIN ({_half('click')}) b ON b.user_id = a.user_id AND b.hour = a.hour")
def forecast_observation_hour_join(spark, sf_dir):
    """Forecast and observation of one station on the rounded hour."""
    mean = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id", times.hour_half_even(F.col("ts")).alias("hour")).agg(F.avg("value").alias(name))
    return mean("view", "a").join(mean("click", "b"), ["user_id", "hour"]).select("user_id", "hour", r(F.col("a") - F.col("b")).alias("error"))


@query("""SELECT vec_id, label, CAST(place AS INT) AS place, round(CAST(v AS DOUBLE), 6) AS value, o_orderkey FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS place, unnest(embedding) AS v, vec_id * 64 + unnest(range(len(embedding))) AS k FROM embeddings) JOIN orders ON o_orderkey = k""")
def array_position_join(spark, sf_dir):
    """Predictions kept in arrays, joined with rows whose key gives array and place."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("place", "v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return cells.join(orders, F.col("o_orderkey") == F.col("vec_id") * 64 + F.col("place")).select("vec_id", "label", "place", r(F.col("v").cast("double")).alias("value"), "o_orderkey")


@query("""SELECT median(n) AS per_day, count(*) AS days, min(n) AS least FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY ALL)""")
def coverage_median(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("n"))
    return d.agg(F.median("n").alias("per_day"), F.count("*").alias("days"), F.min("n").alias("least"))  # a row for each day


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(month AS DATE) AS month, n FROM m WHERE n >= 0.25 * (SELECT median(n) FROM m)""")
def covered_months(spark, sf_dir):
    """Months with at least a quarter of the median month's rows."""
    m = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    half = m.agg(F.median("n").alias("half"))
    return m.join(F.broadcast(half)).where(F.col("n") >= 0.25 * F.col("half")).select("month", "n")  # one row


@query("""SELECT n_nationkey, coalesce(n, 0) AS n, coalesce(rich, 0) AS rich, coalesce(n, 0) >= 5 AS covered FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS rich FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey""")
def dimension_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    return tables.dense_left(table(spark, sf_dir, "nation").select("n_nationkey"), n, ["n_nationkey"]).withColumn("covered", F.col("n") >= 5)


@query("""SELECT status, count(*) AS n, max(day) AS last, count(DISTINCT day) AS days FROM (SELECT CASE WHEN n >= 8 THEN 'complete' WHEN n >= 3 THEN 'pending' ELSE 'failed' END AS status, day FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)) GROUP BY status""")
def manifest_status(spark, sf_dir):
    """Entries of a manifest by status, and the last of each; the manifest is a map from day to status."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") >= 8, "complete").when(F.col("n") >= 3, "pending").otherwise("failed")
    return d.select(F.explode(F.create_map(F.col("day"), status)).alias("day", "status")).groupBy("status").agg(F.count("*").alias("n"), F.max("day").alias("last"), F.count_distinct("day").alias("days"))


@query("""SELECT l_shipmode, runs, round(primary_mean, 6) AS primary_mean, CAST(row_number() OVER (ORDER BY round(primary_mean, 9), l_shipmode) AS INT) AS place FROM (SELECT l_linenumber AS l_shipmode, count(*) AS runs, avg(abs(l_quantity - l_tax * 600)) AS primary_mean FROM lineitem GROUP BY ALL)""")
def experiment_ladder(spark, sf_dir):
    """Configurations by their mean error, the best first."""
    x = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("l_shipmode")).agg(F.count("*").alias("runs"), F.avg(F.abs(F.col("l_quantity") - F.col("l_tax") * 600)).alias("m"))
    return x.select("l_shipmode", "runs", r(F.col("m")).alias("primary_mean"), F.row_number().over(Window.orderBy(r(F.col("m"), 9), "l_shipmode")).alias("place"))  # a row for each configuration


@query("""SELECT c_nationkey, CAST(count(*) AS BIGINT) AS years, round_even(avg(inches) * 25.4::DOUBLE, 2) AS normal_mm FROM (SELECT c_nationkey, year(o_orderdate) AS y, sum(o_totalprice) / 1e6 AS inches FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) GROUP BY c_nationkey HAVING count(*) >= 5""")
def normal_with_least_years(spark, sf_dir):
    """The mean of yearly sums, where there are years enough, rounded to even."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    y = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") / 1e6).alias("inches"))
    return y.groupBy("c_nationkey").agg(F.count("*").alias("years"), F.bround(F.avg("inches") * 25.4, 2).alias("normal_mm")).where("years >= 5")


@query("""WITH t AS (SELECT quantile_cont(l_quantity, 0.2) AS a, quantile_cont(l_quantity, 0.2) AS b, quantile_cont(l_quantity, 0.6) AS c, quantile_cont(l_quantity, 0.5) AS d FROM lineitem), u AS (SELECT a, greatest(b, a + 1e-6) AS b, c, d FROM t), v AS (SELECT a, b, greatest(c, b + 1e-6) AS c, d FROM u)
SELECT round(a, 7) AS t1, round(b, 7) AS t2, round(c, 7) AS t3, round(greatest(d, c + 1e-6), 7) AS t4 FROM v""")
def strictly_rising_thresholds(spark, sf_dir):
    """Each threshold at least a millionth above the one before."""
    q = ranks.quantiles(_lines(spark, sf_dir), [], "l_quantity", {f"q{i}": (p, "linear") for i, p in enumerate((0.2, 0.2, 0.6, 0.5))})
    q = q.select(F.array(*(F.col(f"q{i}") for i in range(4))).alias("t"))
    up = q.select(metrics.strictly_rising(F.col("t")).alias("t"))
    return up.select(*(r(F.col("t")[i], 7).alias(f"t{i + 1}") for i in range(4)))


CLASSED = "SELECT l_returnflag AS grp, CAST(least(4, floor(l_quantity / 10.2::DOUBLE)) AS INT) AS a, CAST(least(4, floor((l_quantity + l_tax * 100) / 11.7::DOUBLE)) AS INT) AS p FROM lineitem"


@query(f"""WITH x AS ({CLASSED}), c AS (SELECT grp, k, count(*) FILTER (a = k AND p = k) AS tp, count(*) FILTER (a <> k AND p = k) AS fp, count(*) FILTER (a = k AND p <> k) AS fn FROM x, range(0, 5) t(k) GROUP BY ALL), f AS (SELECT grp, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro, sum((tp + fn) * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / sum(tp + fn) AS weighted FROM c GROUP BY grp)
SELECT x.grp, count(*) AS n, round(any_value(macro), 6) AS macro_f1, round(any_value(weighted), 6) AS weighted_f1, round(avg((p >= 2)::INT) FILTER (a >= 2), 6) AS elevated_recall, round(avg((a < 2)::INT) FILTER (p >= 2), 6) AS false_alarms, round(avg((abs(a - p) > 1)::INT), 6) AS over_one, round(avg((p >= 3)::INT) FILTER (a >= 3), 6) AS critical_recall, count(*) FILTER (a >= 2) >= 100 AS supported FROM x JOIN f ON f.grp = x.grp GROUP BY x.grp""")
def category_metrics(spark, sf_dir):
    """Macro and weighted F1 (an absent class counts 0), recall and false alarms of elevated, misses by more than a class, critical recall."""
    q = F.col("l_quantity")
    x = _lines(spark, sf_dir).select(F.col("l_returnflag").alias("grp"), F.least(F.lit(4), F.floor(q / 10.2)).cast("int").alias("a"), F.least(F.lit(4), F.floor((q + F.col("l_tax") * 100) / 11.7)).cast("int").alias("p"))
    return metrics.category_report(x, "grp", "a", "p", 5).select("grp", "n", *(r(F.col(c)).alias(c) for c in ("macro_f1", "weighted_f1", "elevated_recall", "false_alarms", "over_one", "critical_recall")), "supported")


@query("""SELECT l_returnflag, count(*) AS n, round(avg((y BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS width, count(*) FILTER (lo > mid OR mid > hi) AS violations FROM (SELECT *, l_quantity AS y, l_tax * 500 AS mid, l_tax * 500 - 5 - l_discount * 100 AS lo, l_tax * 500 + 20 - l_linenumber * 4 AS hi FROM lineitem) GROUP BY l_returnflag""")
def interval_coverage(spark, sf_dir):
    """How often an interval holds what came, how wide it is, and how often its ends are out of order."""
    mid = F.col("l_tax") * 500
    x = _lines(spark, sf_dir).select("l_returnflag", F.col("l_quantity").alias("y"), mid.alias("mid"), (mid - 5 - F.col("l_discount") * 100).alias("lo"), (mid + 20 - F.col("l_linenumber") * 4).alias("hi"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int"))).alias("coverage"), r(F.avg(F.col("hi") - F.col("lo"))).alias("width"), F.count_if((F.col("lo") > F.col("mid")) | (F.col("mid") > F.col("hi"))).alias("violations"))


@query("""WITH m AS (SELECT l_returnflag, avg(abs(l_quantity - l_tax * 600)) AS mae FROM lineitem GROUP BY ALL), s AS (SELECT mae AS stable FROM m WHERE l_returnflag = 'N') SELECT l_returnflag, round((stable - mae) / stable * 100, 4) AS percent, CASE WHEN mae < stable THEN 'better' WHEN mae > stable THEN 'worse' ELSE 'same' END AS verdict FROM m, s""")
def against_stable(spark, sf_dir):
    m = _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.avg(F.abs(F.col("l_quantity") - F.col("l_tax") * 600)).alias("mae"))
    both = m.join(F.broadcast(m.where("l_returnflag = 'N'").select(F.col("mae").alias("stable"))))  # one row
    return both.select("l_returnflag", r((F.col("stable") - F.col("mae")) / F.col("stable") * 100, 4).alias("percent"), F.when(F.col("mae") < F.col("stable"), "better").when(F.col("mae") > F.col("stable"), "worse").otherwise("same").alias("verdict"))


@query("""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))
SELECT day AS run, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS side, CAST(greatest(0, 3 - (n - k)) AS INT) AS fold, day > DATE '1999-06-01' AS prospective FROM d""")
def chronological_three_way(spark, sf_dir):
    """Runs in order: 80, 10 and 10 %; the last three are validation folds of their own; those after a cutoff are prospective."""
    runs = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("run")).distinct()
    x = splits.shares(runs, "run", [("train", 0.8), ("validation", 0.9), ("test", 1.0)])
    return x.select("run", "side", F.greatest(F.lit(0), 3 - (F.col("n") - F.col("k"))).cast("int").alias("fold"), (F.col("run") > F.lit("1999-06-01").cast("date")).alias("prospective"))


@query("""WITH d AS (SELECT day, n, sum(hits) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_totalprice > 400000) AS hits FROM orders GROUP BY ALL))
SELECT day, CASE WHEN k <= 30 OR upto <= 40 THEN 'test' ELSE 'train' END AS side, n FROM d""")
def holdout_extended_for_support(spark, sf_dir):
    """The last thirty days are held out, and earlier ones until they hold forty events; days, not rows, reach the window."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("hits"))
    by = Window.orderBy(F.desc("day"))
    d = d.withColumn("k", F.row_number().over(by)).withColumn("upto", F.sum("hits").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select("day", F.when((F.col("k") <= 30) | (F.col("upto") <= 40), "test").otherwise("train").alias("side"), "n")


@query("""SELECT side, days, sha256(keys) AS key_hash FROM (SELECT CASE WHEN month(day) % 4 = 1 THEN 'test' ELSE 'train' END AS side, count(*) AS days, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS keys FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY 1)""")
def split_manifest(spark, sf_dir):
    """Each side of a split with the hash of its sorted days."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("side", F.when(F.month("day") % 4 == 1, "test").otherwise("train"))
    keys = F.array_join(F.sort_array(F.collect_list(F.date_format("day", "yyyy-MM-dd"))), ",")  # days of a calendar
    return d.groupBy("side").agg(F.count("*").alias("days"), F.sha2(keys, 256).alias("key_hash"))


@query("""SELECT greatest(a0, b0) AS first, least(a1, b1) AS last, CAST(greatest(0, datediff('day', greatest(a0, b0), least(a1, b1)) + 1) AS INT) AS days FROM (SELECT CAST(min(o_orderdate) AS DATE) AS a0, CAST(max(o_orderdate) AS DATE) AS a1 FROM orders), (SELECT CAST(min(l_shipdate) AS DATE) AS b0, CAST(max(l_shipdate) AS DATE) AS b1 FROM lineitem)""")
def date_overlap(spark, sf_dir):
    ends = lambda name, c, p: table(spark, sf_dir, name).agg(F.to_date(F.min(c)).alias(f"{p}0"), F.to_date(F.max(c)).alias(f"{p}1"))
    both = ends("orders", "o_orderdate", "a").join(F.broadcast(ends("lineitem", "l_shipdate", "b")))  # one row each
    first, last = F.greatest("a0", "b0"), F.least("a1", "b1")
    return both.select(first.alias("first"), last.alias("last"), F.greatest(F.lit(0), F.datediff(last, first) + 1).alias("days"))


@query("""SELECT quality AS class, count(*) AS n, count(DISTINCT doc_id % 50) AS groups, count(*) >= 30 AND count(DISTINCT doc_id % 50) >= 10 AS passed FROM labels GROUP BY quality""")
def label_gate(spark, sf_dir):
    """Each class needs rows and distinct groups enough."""
    x = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("class")).agg(F.count("*").alias("n"), F.count_distinct(F.col("doc_id") % 50).alias("groups"))
    return x.withColumn("passed", (F.col("n") >= 30) & (F.col("groups") >= 10))


@query("""SELECT channel, lead, count(*) AS n, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae FROM (UNPIVOT (SELECT l_linenumber AS lead, l_quantity - l_tax * 600 AS quantity, l_discount - l_tax AS discount FROM lineitem) ON quantity, discount INTO NAME channel VALUE e) GROUP BY ALL""")
def errors_by_lead_and_channel(spark, sf_dir):
    x = _lines(spark, sf_dir).select(F.col("l_linenumber").alias("lead"), (F.col("l_quantity") - F.col("l_tax") * 600).alias("quantity"), (F.col("l_discount") - F.col("l_tax")).alias("discount"))
    return x.unpivot("lead", None, "channel", "e").groupBy("channel", "lead").agg(F.count("*").alias("n"), r(F.avg("e")).alias("bias"), r(F.avg(F.abs("e"))).alias("mae"))


@query("""SELECT DISTINCT h AS hour FROM (SELECT unnest(generate_series(CAST(o_orderdate AS TIMESTAMP) - INTERVAL 12 HOUR, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 5 AS INT)), INTERVAL 1 HOUR)) AS h FROM orders)""")
def required_hours(spark, sf_dir):
    """Each hour that some run needs, from twelve before it to its last lead, once."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("t"), (F.col("o_orderkey") % 5).cast("int").alias("n")).distinct()
    hours = F.sequence(F.col("t") - F.expr("INTERVAL 12 HOURS"), F.col("t") + F.make_dt_interval(F.lit(0), F.col("n")), F.expr("INTERVAL 1 HOUR"))
    return o.select(F.explode(hours).alias("hour")).distinct()


@query("""WITH c AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT c.day, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'thin' ELSE 'present' END AS status FROM c LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) o ON o.day = c.day""")
def coverage_calendar(spark, sf_dir):
    """Each day of a range with what it holds; days without any are missing."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1996-03-31").cast("date"))).alias("day"))
    n = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    both = days.join(n, "day", "left")
    return both.select("day", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("n") < 3, "thin").otherwise("present").alias("status"))


@query("""SELECT l_returnflag, round(avg(abs(e)), 6) AS overall, round(avg(abs(e)) FILTER (month(l_shipdate) IN (6, 7, 8)), 6) AS summer, round(avg(abs(e)) FILTER (l_quantity <= 6), 6) AS critical, round(avg(abs(e)) FILTER (d > 0), 6) AS wetting, CASE WHEN count(*) FILTER (d < 0) >= 50 THEN round(avg(abs(e)) FILTER (d < 0), 6) END AS drying FROM (SELECT *, l_quantity - l_tax * 600 AS e, l_discount - 0.05::DOUBLE AS d FROM lineitem) GROUP BY l_returnflag""")
def regime_errors(spark, sf_dir):
    """Errors overall and by regime, null where a regime has too few rows."""
    e, d = F.abs(F.col("l_quantity") - F.col("l_tax") * 600), F.col("l_discount") - 0.05
    part = lambda ok: r(F.avg(F.when(ok, e)))
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(
        r(F.avg(e)).alias("overall"), part(F.month("l_shipdate").isin(6, 7, 8)).alias("summer"), part(F.col("l_quantity") <= 6).alias("critical"), part(d > 0).alias("wetting"), F.when(F.count_if(d < 0) >= 50, part(d < 0)).alias("drying")
    )
