"""Streams over files written from the events table, each run to its end; a last row far ahead lets the watermark pass all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.functions.weather import equilibrium_moisture
from kindling.operators import folds
from kindling.operators.shared import shared_dir
from kindling.plans import series
from kindling.plans.common import r, registry, table
from kindling.streaming import ordered

QUERIES, ORACLES, query = registry()

#: Delay of the watermark; more than the months that the table covers, so rows may come in any order.
LATE = "400 DAYS"


def _stream(rows, at: str, parts: int = 8):
    """`rows` as a stream of files, dealt by hash, and behind them a row without an id whose time is far ahead."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    rows.repartition(parts, F.xxhash64(*rows.columns)).write.parquet(path)
    end = rows.agg(F.max(at).alias(at)).select(*(F.col(at) + F.expr("INTERVAL 900 DAYS") if c == at else F.lit(-1).cast("long") if c == "user_id" else F.lit(None).cast(t) for c, t in rows.dtypes)).toDF(*rows.columns)
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, parts // 2)).parquet(path)


def _run(stream):
    spark = stream.sparkSession
    path = shared_dir(spark)
    dropped = ordered.run_available(stream, f"{path}/out", f"{path}/checkpoint")
    if dropped:
        raise ValueError(f"{dropped} rows came later than {LATE}")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(series.ORACLES["dead_fuel_fold"])
def stream_fuel_fold(spark, sf_dir):
    """The fuel moisture of each station as a stream in event time: rows in any order, states as of a fold in order."""
    level = equilibrium_moisture(F.least(F.col("value") / 10, F.lit(40.0)), F.get_json_object("props", "$.k").cast("double"))
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", level.alias("q"), F.lit(0.0).alias("p"))
    step = folds.moisture()
    states = ordered.folded(_stream(rows, "ts").na.fill(0.0, ["q", "p"]), "user_id", "ts", ["event_id"], ["q", "p"], (10.0,), step, ["k"], LATE)
    return _run(states).where("user_id >= 0").select("event_id", r(F.col("k"), 5).alias("fm"))


def _partner(spark, sf_dir, kinds, before, after, order, keep):
    e = _events(spark, sf_dir)
    left = e.where(F.col("event_type") == kinds[0]).select("user_id", "ts", "event_id")
    right = e.where(F.col("event_type") == kinds[1]).select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    pairs = ordered.interval_join(_stream(left, "ts"), _stream(right, "seen"), "user_id", "ts", "seen", before, after, LATE)
    pairs = pairs.select("_at", "event_id", "seen_id", "seen_value", F.unix_micros("_seen").alias("seen_us"), F.abs(F.unix_micros("_seen") - F.unix_micros("_at")).alias("gap_us"))
    return _run(ordered.best(pairs, ["event_id"], order, keep)).where("event_id is not null")


@query(series.ORACLES["nearest_within_30min"])
def stream_nearest_within_30min(spark, sf_dir):
    """Two streams joined by an interval; of the rows within half an hour the nearest one, null where there is none."""
    found = _partner(spark, sf_dir, ("error", "click"), "30 MINUTES", "30 MINUTES", [F.col("gap_us"), F.col("seen_us"), F.col("seen_id")], ["seen_id", "gap_us"])
    return found.select("event_id", F.col("seen_id").alias("click_id"), "gap_us")


@query(series.ORACLES["asof_initial_max_age"])
def stream_initial_max_age(spark, sf_dir):
    """The latest row of another stream that is at most three hours old, null where there is none."""
    found = _partner(spark, sf_dir, ("purchase", "view"), "3 HOURS", "0 HOURS", [-F.col("seen_us"), -F.col("seen_id")], ["seen_id", "seen_value"])
    return found.select("event_id", F.col("seen_id").alias("view_id"), F.col("seen_value").alias("view_value"))
