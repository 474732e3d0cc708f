"""Joins in time. Each has an equi key: the entity and a bucket of the time axis, so that no
entity has to fit one task and nothing becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keys else prefix + c) for c in df.columns))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, max_age: int, order: list[str]) -> DataFrame:
    """All of `left` with the last row of `right` at or before it, at most `max_age` old; columns of
    `right` get the prefix r_. Times are integers. `order` breaks ties among rows of one time.

    A bucket is max_age wide; right rows stand in their own and in the next one, so each
    left row finds all its candidates in its bucket.
    """
    right = _names(right, "r_", keys)
    hit, at = F.struct(*right.columns), f"r_{right_at}"
    stacked = left.select(*keys, F.col(left_at).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("_r"), F.floor(F.col(left_at) / max_age).alias("_b")).unionByName(
        right.select(*keys, F.col(at).alias("_t"), hit.alias("_r"), F.explode(F.array(F.floor(F.col(at) / max_age), F.floor(F.col(at) / max_age) + 1)).alias("_b")), allowMissingColumns=True
    )
    by = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_l").isNotNull(), *(F.col("_r")[f"r_{c}"] for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_r", F.last("_r", ignorenulls=True).over(by)).where("_l is not null")
    fresh = F.col("_t") - F.col("_r")[at] <= max_age
    return found.select("_l.*", *(F.when(fresh, F.col("_r")[c]).alias(c) for c in right.columns if c not in keys))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance: int) -> DataFrame:
    """All pairs of one key whose times differ by at most `tolerance`; columns of `right` get r_."""
    right = _names(right, "r_", keys)
    near = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col(left_at) / tolerance) + d for d in (-1, 0, 1)))))
    pairs = near.join(right.withColumn("_b", F.floor(F.col(f"r_{right_at}") / tolerance)), [*keys, "_b"])
    return pairs.where(F.abs(F.col(f"r_{right_at}") - F.col(left_at)) <= tolerance).drop("_b")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance: int, row: str, order: list[str]) -> DataFrame:
    """All of `left` (row names it) with its nearest partner in `right`, the earlier one if two are as near; columns of `right` get r_."""
    pairs = within(left.select(*keys, row, left_at), right, keys, left_at, right_at, tolerance)
    taken = [c for c in pairs.columns if c.startswith("r_")]
    rank = F.struct(F.abs(F.col(f"r_{right_at}") - F.col(left_at)).alias("d"), F.col(f"r_{right_at}").alias("t"), *(F.col(f"r_{c}").alias(f"o_{c}") for c in order))
    best = pairs.groupBy(row).agg(F.min_by(F.struct(*taken), rank).alias("_best"))
    return left.join(best, row, "left").select(*left.columns, *(F.col("_best")[c].alias(c) for c in taken))


def trailing(keys: list[str], *order, rows: int, skip: int = 0) -> Window:
    """The `rows` rows that end `skip` before this one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1 + skip), -skip)


def trailing_time(keys: list[str], at: str, span: int) -> Window:
    """Half open: later than at - span, up to at."""
    return Window.partitionBy(*keys).orderBy(at).rangeBetween(-span + 1, 0)


def since_event(df: DataFrame, keys: list[str], order: list[str], event: Column, name: str) -> DataFrame:
    """Adds how many rows ago the event last held: 0 on it, and from 1 on before the first."""
    by = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_e", event.cast("int")).withColumn("_i", F.sum("_e").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    island = F.row_number().over(Window.partitionBy(*keys, "_i").orderBy(*order))
    return marked.withColumn(name, F.when(F.col("_i") == 0, island).otherwise(island - 1).cast("long")).drop("_e", "_i")


def mean_rank(keys: list[str], value: str) -> Column:
    """Rank over count, ties at their mean rank."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return (F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2) / F.count("*").over(Window.partitionBy(*keys))
