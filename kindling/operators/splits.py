"""Leakage-safe splits. They rank distinct days, runs or episodes, never rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.operators.ranks import quantiles


def blocks(df: DataFrame, unit: str, n: int) -> DataFrame:
    """unit and its block, 0 to n - 1, in order; larger blocks first."""
    return df.select(unit).distinct().withColumn("block", (F.ntile(n).over(Window.orderBy(unit)) - 1).cast("int"))


def folds(block_table: DataFrame, unit: str, n: int) -> DataFrame:
    """Each unit once per fold: validation where its block is the fold, else train."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold")
    return block_table.select(unit, "block", fold).withColumn("side", F.when(F.col("block") == F.col("fold"), "validation").otherwise("train"))


def purged_days(df: DataFrame, day: str, width: int = 14, every: int = 4, purge: int = 7) -> DataFrame:
    """day and its side. Days form blocks from the first day on; of those present the second of every
    four is test, and train days within `purge` days of one are purged."""
    days = df.select(day).distinct().withColumn("_first", F.min(day).over(Window.partitionBy(F.lit(0))))
    days = days.withColumn("_b", F.floor(F.datediff(day, "_first") / width))
    days = days.withColumn("_test", (F.dense_rank().over(Window.orderBy("_b")) - 1) % every == 1)
    spread = days.where("_test").select(F.explode(F.expr(f"sequence(date_sub({day}, {purge}), date_add({day}, {purge}))")).alias(day)).distinct().withColumn("_near", F.lit(True))
    side = F.when(F.col("_test"), "test").when(F.col("_near"), "purged").otherwise("train")
    return days.join(spread, day, "left").select(day, side.alias("side"))


def hashed_side(name: Column, every: int = 5) -> Column:
    """test where the SHA-1 of the name, a number of 160 bits, divides by 5: 16 leaves 1, so its hex digits are summed."""
    if every != 5:
        raise ValueError("the digit sum gives remainders of 5 only")
    digits = F.transform(F.split(F.sha1(name.cast("string").cast("binary")), ""), lambda d: F.when(d != "", F.conv(d, 16, 10).cast("int")).otherwise(0))
    return F.when(F.aggregate(digits, F.lit(0), lambda a, b: a + b) % 5 == 0, "test").otherwise("train")


def char_sum_held(name: Column, every: int = 5) -> Column:
    codes = F.transform(F.split(name.cast("string"), ""), lambda c: F.when(c != "", F.ascii(c)).otherwise(0))
    return F.aggregate(codes, F.lit(0), lambda a, b: a + b) % every == 0


def time_holdout(df: DataFrame, group: str, at: str, share: float) -> DataFrame:
    """group and its side: test if all of it lies after the cut, train if all before; straddlers are dropped."""
    cut = quantiles(df, [], at, {"_cut": (1 - share, "linear")})
    spans = df.groupBy(group).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    side = F.when(F.col("_b") < F.col("_cut"), "train").when(F.col("_a") >= F.col("_cut"), "test").otherwise("dropped")
    return spans.join(F.broadcast(cut)).select(group, side.alias("side"))  # one row


def chronological(df: DataFrame, run: str, at: str, share: float = 0.8) -> DataFrame:
    """run and its side, by the order of distinct runs."""
    runs = df.groupBy(run).agg(F.min(at).alias("_t"))
    place, n = F.row_number().over(Window.orderBy("_t", run)), F.count("*").over(Window.partitionBy(F.lit(0)))
    return runs.select(run, F.when(place <= F.greatest(F.lit(1), F.floor(n * share)), "development").otherwise("holdout").alias("side"))


def shares(runs: DataFrame, run: str, sides: list[tuple[str, float]]) -> DataFrame:
    """Distinct runs with side, place k and number n; sides are (name, share up to and with it), in order of the runs."""
    x = runs.withColumn("k", F.row_number().over(Window.orderBy(run))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    side = F.when(F.lit(False), F.lit(""))
    for name, upto in sides:
        side = side.when(F.col("k") <= F.floor(F.col("n") * upto), name)
    return x.withColumn("side", side.otherwise(sides[-1][0]))
