"""Observations as a stream: bounded staleness by watermark, and a state per station."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hourly(stream: DataFrame, keys: list[str], at: str, value: str, late: str = "3 hours") -> DataFrame:
    """Count and mean per hour; rows later than `late` are dropped."""
    timed = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", "1 hour").alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("hour"), *keys, "n", "mean")


def moisture(stream: DataFrame, key: str, at: str, level: str, start: float = 10.0, dry_hours: float = 10.0, wet_hours: float = 6.0) -> DataFrame:
    """Each station's fuel moisture carried over batches toward an equilibrium `level`, a step per row in time order."""
    import math

    dry, wet = 1 - math.exp(-1 / dry_hours), 1 - math.exp(-1 / wet_hours)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values(at)
        for x in rows[level]:
            now += (x - now) * (dry if x < now else wet)
        state.update((now,))
        yield pd.DataFrame({key: [name[0]], "fm": [now]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, fm double", "fm double", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Takes all that is there, once; a second run with the same checkpoint takes only what is new.

    Each batch is a folder of its own under `path`, written over if the batch is retried. In complete mode the last
    batch is the whole result, else all batches are.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.parquet(path)
    if mode == "complete":
        last = found.agg(F.max("batch").alias("batch"))
        found = found.join(F.broadcast(last), "batch")  # one row
    return found.drop("batch")
