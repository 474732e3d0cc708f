"""What the plans share: tables, and the bindings of stations and places to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions.times import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: user_id is the station, `at` the time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def place(df: DataFrame, key: str) -> DataFrame:
    """Adds lat and lon by arithmetic on a key."""
    k = F.col(key).cast("long")
    return df.withColumn("lat", 36 + (k * 37 % 500) / F.lit(100.0)).withColumn("lon", -95 + (k * 53 % 600) / F.lit(100.0))


def registry():
    """Two dicts and a decorator that files a query, with its SQL, under its function's name."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def file(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return file

    return queries, oracles, query


#: SQL of place() and of the great circle, for the oracles.
LAT, LON = "(36 + ({0} * 37 % 500) / 100.0::DOUBLE)", "(-95 + ({0} * 53 % 600) / 100.0::DOUBLE)"
GREAT_CIRCLE = (
    "(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2), 1.0))))"
)
