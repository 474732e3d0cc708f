"""Runs over archives of files that are first written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators.shared import cut, shared_dir
from kindling.plans.common import r, registry, table
from kindling.sources import resumable
from kindling.sources.log import Log
from kindling.sources.models import Registry

QUERIES, ORACLES, query = registry()


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS source, o_orderkey, o_totalprice FROM orders),
    s AS (SELECT source, count(*) AS n, sum(o_totalprice) AS total FROM m GROUP BY source)
    SELECT source, CASE WHEN source LIKE '%-02' THEN 'failed' ELSE 'complete' END AS status, CASE WHEN source LIKE '%-02' THEN 'permanent' END AS error_class,
        CASE WHEN source NOT LIKE '%-02' THEN n END AS n, CASE WHEN source NOT LIKE '%-02' THEN round(total, 2) END AS total,
        CASE WHEN source LIKE '%-02' THEN 'given_up' ELSE 'done' END AS next FROM s""")
def resumable_months(spark, sf_dir):
    """Months of orders as sources: a run that is stopped half-way, its resumption, and the manifest after it.

    The work refuses Februaries. What the next run would do with each source is the last column.
    """
    path = shared_dir(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    orders.repartition("month").write.partitionBy("month").parquet(f"{path}/in")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/in").select("path", "length", F.unix_micros("modificationTime").alias("time"))
    files = files.withColumn("source", F.regexp_extract("path", r"month=([^/]+)/", 1))
    log, started = Log(spark, f"{path}/log", resumable.STATES), []

    class Stopped(BaseException):
        pass

    def work(own):
        started.append(1)
        if len(started) == 2:
            raise Stopped
        rows = spark.read.schema("o_orderkey LONG, o_totalprice DOUBLE").parquet(*(x.path for x in own.select("path").collect()))  # the files of a batch
        rows = rows.select(F.regexp_extract("_metadata.file_path", r"month=([^/]+)/", 1).alias("source"), "o_orderkey", "o_totalprice")
        bad = rows.where(F.endswith("source", F.lit("-02"))).select("source", F.lit(resumable.PERMANENT).alias("error_class"), F.lit("a short month").alias("error")).distinct()
        return rows, bad

    for _ in range(2):
        try:
            resumable.run(log, files, work, f"{path}/out", "orders by month, 1", per_batch=40)
        except Stopped:
            pass
    found = resumable.results(log, f"{path}/out", "source STRING, o_orderkey LONG, o_totalprice DOUBLE")
    sums = found.groupBy("source").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
    plan = resumable.planned(resumable.fingerprinted(files, "orders by month, 1"), log).select("source", F.col("todo").alias("next"))
    return log.latest("source").join(sums, "source", "left").join(plan, "source").select("source", "status", "error_class", "n", "total", "next")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, CAST(floor((year(o_orderdate) - 1992) / 3) AS INT) AS p, count(*) AS n, sum(o_orderkey % 1000)::DOUBLE AS perf FROM orders GROUP BY ALL),
    c AS (SELECT o_custkey, p, n, perf, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS k FROM o),
    s AS (SELECT o_custkey, 0::BIGINT AS k, 0 AS mi, 0 AS pa, NULL::DOUBLE AS sp, NULL::INT AS bmi, NULL::INT AS bpa, NULL::INT AS bn, 0::BIGINT AS acts FROM c WHERE k = 1
        UNION ALL SELECT s.o_custkey, s.k + 1, CASE WHEN up THEN nmi ELSE mi END, CASE WHEN up THEN npa ELSE pa END, CASE WHEN up THEN perf ELSE sp END,
            CASE WHEN NOT up THEN nmi END, CASE WHEN NOT up THEN npa END, CASE WHEN NOT up THEN (CASE WHEN bmi = nmi AND bpa = npa THEN bn + 1 ELSE 1 END) END, acts + CASE WHEN up THEN 2 ELSE 1 END
        FROM s JOIN c ON c.o_custkey = s.o_custkey AND c.k = s.k + 1, LATERAL (SELECT CASE WHEN n >= 4 THEN mi + 1 ELSE mi END AS nmi, CASE WHEN n >= 4 THEN 0 ELSE pa + 1 END AS npa, perf > coalesce(sp, 1500) AS up))
    SELECT CAST(o_custkey AS VARCHAR) AS model, CASE WHEN sp IS NOT NULL THEN '0.' || mi || '.' || pa END AS stable, sp AS performance, CASE WHEN bn IS NOT NULL THEN '0.' || bmi || '.' || bpa || '-beta.' || bn END AS beta, least(20, acts) AS kept
    FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC) = 1""")
def registry_by_log(spark, sf_dir):
    """A round of candidates every three years, a model for each customer with orders in those years; those that beat the stable release are promoted."""
    o = table(spark, sf_dir, "orders").withColumn("p", F.floor((F.year("o_orderdate") - 1992) / 3))
    rounds = o.groupBy(F.col("o_custkey").cast("string").alias("model"), "p").agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 1000).cast("double").alias("performance"))
    rounds, made = cut(rounds), Registry(spark, f"{shared_dir(spark)}/registry")
    for p in sorted(x[0] for x in rounds.select("p").distinct().collect()):  # one for each three years
        new = rounds.where(F.col("p") == p).withColumns({"channel": F.lit("beta"), "bump": F.when(F.col("n") >= 4, "minor").otherwise("patch"), "assets": F.array().cast("array<struct<role:string,path:string>>")})
        made.register(new)
        better = new.select("model").join(made.state(), "model").where(F.col("beta.performance") > F.coalesce("stable.performance", F.lit(1500.0)))
        made.promote(better.select("model"))
    return made.state().select("model", F.col("stable.release").alias("stable"), F.col("stable.performance").alias("performance"), F.col("beta.release").alias("beta"), "kept")
