"""Running sums, ranks and exact quantiles over all rows of a group, however large: rows are range-partitioned, and the
totals of the ranges before are added to what runs within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.operators.shared import counted_join, cut


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums up to and with each row, by `order`, per key; keys aren't null and `order` tells all rows apart."""
    own = df.select("*", *(v.alias(f"_{n}") for n, v in sums.items()))
    x = cut(own.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = x.groupBy("_part", *keys).agg(*(F.sum(f"_{n}").alias(f"_t{n}") for n in sums))  # one row for each range, and for each key in it
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *keys, *(F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_b{n}") for n in sums))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(totals, ["_part", *keys]).select(*df.columns, *((F.sum(f"_{n}").over(within) + F.col(f"_b{n}")).alias(n) for n in sums))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], own: bool = True) -> DataFrame:
    """df with the last value that isn't null up to each row in ascending `order`, per key; up to the row before it without `own`. Null where there is none.

    A value within a struct is carried even if it is null, as the struct isn't. Keys may be null; `order` tells all rows apart. A range passes on one row a key.
    """
    x = df.select("*", *(v.alias(f"_{n}") for n, v in values.items()))
    x = cut(x.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    ends = x.groupBy("_part", *keys).agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(f"_e{n}") for n in values))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.last(f"_e{n}", True).over(before).alias(f"_b{n}") for n in values))
    same = [F.col("_part") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return x.join(ends, same).select(*df.columns, *(F.coalesce(F.last(f"_{n}", True).over(within), F.col(f"_b{n}")).alias(n) for n in values))


def tile(rank: Column, rows: Column, tiles: int) -> Column:
    """The tile of a rank where `rows` rows are dealt into tiles in order, the larger ones first."""
    size, more = F.floor(rows / tiles), rows % tiles
    edge = more * (size + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (size + 1)) + 1).otherwise(more + F.floor((rank - 1 - edge) / F.greatest(size, F.lit(1))) + 1).cast("int")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]], times: str | None = None) -> DataFrame:
    """A row per key with exact quantiles: wanted is name -> (share, "linear" or "higher"). Nulls don't count; a row counts `times` times.

    Equal values are counted first, so the ranks run over distinct values. The values of a key aren't gathered in a task.
    """
    levels = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    upto = cut(running(levels, keys, [F.col(value)], {"_upto": F.col("_n")}))
    sizes = cut(upto.groupBy(*keys).agg(F.max("_upto").alias("_rows"), F.count("*").alias("_levels")))
    total = sizes.agg(F.sum("_levels")).first()[0] or 0
    met = counted_join(upto, sizes, keys, total, "_levels") if keys else upto.join(F.broadcast(sizes))  # one row
    at = lambda p: F.min(F.when(F.col("_upto") > p, F.col(value)))  # noqa: E731  the value at place p, from 0
    aggs = []
    for name, (share, kind) in wanted.items():
        place = (F.col("_rows") - 1) * share
        low, high = at(F.floor(F.round(place, 9))), at(F.ceil(F.round(place, 9)))
        rest = F.first(F.round(place, 9) - F.floor(F.round(place, 9)))
        aggs.append((low + (high - low) * rest if kind == "linear" else high).alias(name))
    return met.groupBy(*keys).agg(*aggs)
