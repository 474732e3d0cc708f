"""Readers and writers, over files that are first written from the driver's tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindling.functions.times import micros
from kindling.operators import tables
from kindling.operators.shared import shared_dir
from kindling.plans.common import place, r, registry, table
from kindling.sources import sinks, stations

QUERIES, ORACLES, query = registry()


def _written(df, kind="csv", **options):
    path = shared_dir(df.sparkSession)
    df.write.options(**options).format(kind).save(path)
    return path


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus""")
def typed_csv_with_manifest(spark, sf_dir):
    """CSV by its schema, after its files have been held against a manifest of checksums."""
    path = _written(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), header=True)
    manifest = {x.path.rsplit("/", 1)[-1]: x.sha256 for x in stations.checksum(spark, f"{path}/*.csv").collect()}  # one row a file
    x = stations.typed_csv(spark, path, "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE", manifest)
    return x.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT c_custkey AS station, round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT c_custkey, 36 + (c_custkey * 37 % 500) / 100.0::DOUBLE AS lat, -95 + (c_custkey * 53 % 600) / 100.0::DOUBLE AS lon FROM customer) WHERE lat BETWEEN 37 AND 39 AND lon BETWEEN -94 AND -91""")
def pruned_csv_in_box(spark, sf_dir):
    """Three columns of a CSV, renamed, of the points in a box."""
    path = _written(place(table(spark, sf_dir, "customer"), "c_custkey"), header=True)
    x = spark.read.schema("c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING, lat DOUBLE, lon DOUBLE").csv(path, header=True)
    return x.where(F.col("lat").between(37, 39) & F.col("lon").between(-94, -91)).select(F.col("c_custkey").alias("station"), r(F.col("lat"), 4).alias("lat"), r(F.col("lon"), 4).alias("lon"))


@query("""SELECT CAST(user_id AS VARCHAR) AS stid, (CASE WHEN s % 3600 > 1800 OR (s % 3600 = 1800 AND (s // 3600) % 2 = 1) THEN s // 3600 + 1 ELSE s // 3600 END) * 3600000000 AS hour, round(avg(CASE WHEN event_id % 2 = 0 THEN (value - 32) * 5 / 9 ELSE value END), 5) AS temp_c, count(*) AS n FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type IN ('view', 'click')) GROUP BY ALL""")
def polymorphic_observations(spark, sf_dir):
    """Observations from lines that are a list, one observation or a map by station."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = F.struct(F.col("user_id").cast("string").alias("stid"), at.alias("time"), F.col("value").alias("temp"), F.when(F.col("event_id") % 2 == 0, "F").otherwise("C").alias("unit"))
    path, k = shared_dir(spark), F.col("user_id") % 3
    e.where(k == 0).groupBy("user_id").agg(F.to_json(F.collect_list(o)).alias("value")).select("value").write.text(f"{path}/a")
    e.where(k == 1).select(F.to_json(o).alias("value")).write.text(f"{path}/b")
    e.where(k == 2).groupBy("user_id").agg(F.to_json(F.create_map(F.col("user_id").cast("string"), F.collect_list(o.dropFields("stid")))).alias("value")).select("value").write.text(f"{path}/c")
    out = stations.observations_json(spark, f"{path}/*/*.txt", lines=True)
    return out.select("stid", "hour", r(F.col("temp_c"), 5).alias("temp_c"), "n")


@query("""SELECT '2024-01-' || lpad(CAST(1 + n_regionkey AS VARCHAR), 2, '0') AS run_date, CAST(c_nationkey AS VARCHAR) AS stid, count(*) AS n, round(avg(c_acctbal), 4) AS fm FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def nested_forecast_json(spark, sf_dir):
    """Forecasts from files that hold a map of stations, each with a list."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("n_regionkey")).cast("string"), 2, "0"))
    s = c.groupBy(day.alias("run_date"), F.col("c_nationkey").cast("string").alias("id")).agg(F.struct(F.lit(38.0).alias("lat"), F.lit(-92.0).alias("lon"), F.collect_list(F.struct(F.col("c_custkey").alias("lead"), F.col("c_acctbal").alias("fm"))).alias("forecasts")).alias("s"))
    path = shared_dir(spark)
    s.groupBy("run_date").agg(F.map_from_entries(F.collect_list(F.struct("id", "s"))).alias("stations")).select(F.to_json(F.struct("run_date", "stations")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = stations.forecast_json(spark, f"{path}/*.txt", "lead: LONG, fm: DOUBLE")
    return out.groupBy("run_date", "stid").agg(F.count("*").alias("n"), r(F.avg("fm"), 4).alias("fm"))


SERIES = "SELECT CAST(user_id AS VARCHAR) AS stid, date_trunc('second', ts) AS t, arg_max(value, (ts, event_id)) AS fm FROM events GROUP BY ALL"


@query(f"""SELECT stid AS "STID", epoch_us(t) AS us, round(fm, 6) AS fm, round(fm - lag(fm) OVER w, 6) AS change, round(avg(fm) OVER (PARTITION BY stid ORDER BY t ROWS 2 PRECEDING), 6) AS mean3 FROM ({SERIES}) WINDOW w AS (PARTITION BY stid ORDER BY t)""")
def station_series_with_lags(spark, sf_dir):
    """Station files with parallel arrays, as rows with lags; of repeated times the last stays. A file holds the stations of some 20,000 rows."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("STID"), "ts", "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("value").cast("string").alias("v"))
    s = e.groupBy("STID").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "t", "v"))).alias("x"))
    path = shared_dir(spark)
    series = F.create_map(F.lit("date_time"), F.col("x.t"), F.lit("fuel_moisture"), F.col("x.v"))
    one = F.struct("STID", F.lit("MO").alias("STATE"), F.lit("38").alias("LATITUDE"), F.lit("-92").alias("LONGITUDE"), series.alias("OBSERVATIONS"))
    held = s.groupBy(F.pmod(F.xxhash64("STID"), F.lit(max(1, e.count() // 20_000)))).agg(F.collect_list(one).alias("STATION"))
    held.select(F.to_json(F.struct("STATION")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows, by = stations.station_json(spark, f"{path}/*.txt", "MO"), Window.partitionBy("STID").orderBy("time")
    return rows.select("STID", micros(F.col("time")).alias("us"), r(F.col("fm")).alias("fm"), r(F.col("fm") - F.lag("fm").over(by)).alias("change"), r(F.avg("fm").over(by.rowsBetween(-2, 0))).alias("mean3"))


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def many_files_one_table(spark, sf_dir):
    """CSV and Parquet files of overlapping rows, read together; each key once."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), shared_dir(spark)
    o.where("o_orderkey % 3 <> 0").write.option("header", True).csv(f"{path}/in/a")
    o.where("o_orderkey % 3 <> 1").write.parquet(f"{path}/in/b")
    both = stations.tables(spark, f"{path}/in", "o_orderkey LONG, o_custkey LONG, o_totalprice DOUBLE")
    return tables.last_per_key(both, ["o_orderkey"], ["o_totalprice", "o_custkey"]).withColumn("o_totalprice", r(F.col("o_totalprice"), 2))


@query("""SELECT CAST(n_nationkey * 100 AS BIGINT) AS first, CASE WHEN n_nationkey < 23 THEN CAST(n_nationkey * 100 + 199 AS BIGINT) END AS last, CAST(2 AS BIGINT) AS messages FROM nation WHERE n_nationkey % 5 = 3""")
def index_byte_ranges(spark, sf_dir):
    """Byte ranges of the messages of an index whose names match; neighbours are one range, the last of a file is open."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.concat_ws(":", (k + 1).cast("string"), (k * 100).cast("string"), F.lit("d=20240101"), F.concat(F.lit("V"), (k % 5).cast("string")), F.lit("surface")).alias("value"))
    path = shared_dir(spark)
    n.coalesce(1).write.text(path)
    return stations.index_ranges(spark, f"{path}/*.txt", "^V[34]:").select("first", "last", "messages")


@query("""SELECT o_custkey AS run, bool_or(v IS NOT NULL) AS finite, min(lead) <= 1 AND max(lead) >= 4 AS covered, coalesce(bool_or(v < 0), false) AS negative FROM (SELECT o_custkey, l_linenumber AS lead, CASE WHEN l_linenumber <> 3 THEN l_quantity - 2 END AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_custkey""")
def run_validation(spark, sf_dir):
    """Runs with nothing finite, leads that don't reach, or negative amounts."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.select(F.col("o_custkey").alias("run"), F.col("l_linenumber").alias("lead"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") - 2).alias("v"))
    return stations.lead_problems(x, "run", "lead", "v", 1, 4)


@query("""SELECT vec_id, CAST(label AS BIGINT) AS label, round(CAST(embedding[4 * 8 + 3] AS DOUBLE), 6) AS value FROM embeddings""")
def point_at_first_lead(spark, sf_dir):
    """A grid's value at one place and the first lead from four on."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    at = cells.select("vec_id", "label", F.floor(F.col("i") / 8).alias("lead"), (F.col("i") % 8).alias("x"), "v").where("x = 2 and lead >= 4")
    return at.groupBy("vec_id").agg(F.first("label").cast("long").alias("label"), r(F.min_by("v", "lead").cast("double")).alias("value"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS stations FROM events WHERE user_id % 9 <> 4 GROUP BY ALL""")
def split_by_day(spark, sf_dir):
    """A long response by UTC day, without the stations that are ignored."""
    events = table(spark, sf_dir, "events")
    ignored = events.select("user_id").distinct().where("user_id % 9 = 4")
    e = events.join(ignored, "user_id", "left_anti")
    return e.groupBy(F.to_date(F.substring(F.col("ts").cast("string"), 1, 10)).alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("stations"))


@query("""SELECT month, n, month = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders) AS latest FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL)""")
def files_by_name(spark, sf_dir):
    """What files there are, by a part of their names, with their rows; the latest is marked."""
    path = shared_dir(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).repartition("month").write.partitionBy("month").parquet(path)
    rows = spark.read.parquet(f"{path}/month=*/*.parquet").select(F.regexp_extract("_metadata.file_path", r"month=(\d{4}-\d{2})", 1).alias("month"))
    n = rows.groupBy("month").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.max("month").alias("top")))).select("month", "n", (F.col("month") == F.col("top")).alias("latest"))  # one row


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag""")
def evidence_and_report(spark, sf_dir):
    """Compressed evidence, written once, and a report appended twice; both read back."""
    x, path = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), shared_dir(spark)
    sinks.evidence(x, f"{path}/evidence")
    back = spark.read.schema("l_returnflag STRING, l_quantity DOUBLE").csv(f"{path}/evidence", header=True)
    out = back.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("total"))
    for _ in range(2):
        sinks.report(out, f"{path}/report")
    told = spark.read.schema("l_returnflag STRING, n LONG, total DOUBLE").json(f"{path}/report")
    return told.groupBy("l_returnflag").agg(F.max("n").alias("n"), F.max("total").alias("total"))


@query("""SELECT day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) WHERE day NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_linenumber = 7)""")
def missing_remote_days(spark, sf_dir):
    """What the remote listing has and the local one lacks."""
    remote = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return remote.join(table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.to_date("l_shipdate").alias("day")), "day", "left_anti")


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment""")
def sql_over_views(spark, sf_dir):
    """A query given as SQL over named tables."""
    own = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment", **own)
