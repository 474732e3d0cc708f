"""Joins on keys, upserts, deletes and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that is largest by `order`, which must name a unique key last."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def dense_left(base: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """All of `base`; facts that are missing are true zeros."""
    joined = base.join(facts, keys, "left")
    return joined.na.fill(0, [c for c in facts.columns if c not in keys])


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All of `left` with its row of `right`; a key that `right` repeats fails the query when it runs."""
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.first(F.struct(*values)).alias("_row"), F.count("*").alias("_n"))
    known = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"{', '.join(keys)} is not unique")))
    return left.join(one.select(*keys, known.alias("_row")), keys, "left").select(*left.columns, *(F.col("_row")[c].alias(c) for c in values))


def unmatched(facts: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    return facts.join(base.select(*keys).distinct(), keys, "left_anti")


def mean_of_present(*columns: Column) -> Column:
    """Mean of those that aren't null."""
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)), n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both by key; a new row wins only if its version is strictly larger."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(F.col(version), -F.col("_new"))).alias("_row"))
    return best.select("_row.*")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first writer of a key wins."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def resolve_chain(links: DataFrame, child: str, parent: str, hops: int = 10) -> DataFrame:
    """child and the root it leads to in at most `hops` steps, with the steps taken."""
    state = links.select(F.col(child), F.col(parent).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    state = state.withColumn("root", F.coalesce("root", F.col(child)))
    up = links.where(F.col(parent).isNotNull()).select(F.col(child).alias("_at"), F.col(parent).alias("_to"))
    for _ in range(hops - 1):
        state = state.join(up, state["root"] == up["_at"], "left").select(child, F.coalesce("_to", "root").alias("root"), (F.col("depth") + F.col("_to").isNotNull().cast("int")).alias("depth"))
    return state


def compare(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per value column: keys in both, only in one, and values that differ by more than the tolerance; nulls are equal."""
    left = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("_a"))
    right = b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("_b"))
    both = left.join(right, keys, "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differs = lambda v: ~(F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) | F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance + tolerance * F.abs(F.col(f"b_{v}")), F.lit(False)))
    one = both.agg(F.count_if(same).alias("common"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("added"), *(F.count_if(same & differs(v)).alias(f"_{v}") for v in values))
    stacked = F.explode(F.array(*(F.struct(F.lit(v).alias("column_name"), F.col(f"_{v}").alias("mismatches")) for v in values)))
    return one.select("common", "missing", "added", stacked.alias("x")).select("x.column_name", "common", "missing", "added", "x.mismatches")


def first_reason(checks: dict[str, Column], dedup_keys: list[str], order: list[str]) -> Column:
    """The first check that a row fails, in order; `duplicate` among them counts repeats in `order`."""
    out = F.when(F.lit(False), F.lit(""))
    for name, fails in checks.items():
        out = out.when(F.coalesce(fails, F.lit(False)), name)
    again = F.row_number().over(Window.partitionBy(*dedup_keys).orderBy(*order)) > 1
    return out.when(again, "duplicate").otherwise("ok")


def finite(x: Column) -> Column:
    """x, or null where it is infinite or no number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def partial_update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the values of `new` where they aren't null; keys only in `new` are ignored. `new` has each key once."""
    values = [c for c in old.columns if c not in keys]
    both = old.join(new.select(*keys, *(F.col(c).alias(f"_{c}") for c in values if c in new.columns)), keys, "left")
    return both.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in values)).select(*old.columns)


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of `new`, and the rows of `old` whose keys it doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
