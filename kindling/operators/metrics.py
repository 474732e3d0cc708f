"""Verification metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.operators.ranks import running
from kindling.operators.shared import cut


def regression(pred: str, actual: str) -> list[Column]:
    """n, mae, rmse, bias, r and r2 of one group."""
    e, ok = F.col(pred) - F.col(actual), F.col(pred).isNotNull() & F.col(actual).isNotNull()
    y = F.when(ok, F.col(actual))
    n = F.count_if(ok)
    return [
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr(F.when(ok, F.col(pred)), y).alias("r"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * n)).alias("r2"),
    ]


def confusion(df: DataFrame, actual: str, pred: str, classes: list) -> DataFrame:
    """One row per class, one column per predicted class, zeros kept."""
    counts = df.groupBy(actual).pivot(pred, classes).count()
    dim = df.sparkSession.createDataFrame([(c,) for c in classes], df.select(actual).schema)
    return dim.join(counts, actual, "left").na.fill(0, [str(c) for c in classes])


def class_scores(df: DataFrame, actual: str, pred: str, classes: list) -> DataFrame:
    """support, precision, recall and f1 of each class; an absent class has 0."""
    rows = F.explode(F.array(*map(F.lit, classes))).alias("class")
    hits = df.groupBy(actual, pred).agg(F.count("*").alias("n")).select(actual, pred, "n", rows)
    a, p = F.col(actual) == F.col("class"), F.col(pred) == F.col("class")
    c = hits.groupBy("class").agg(*(F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(k) for k, x in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p))))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.select(
        "class", (F.col("tp") + F.col("fn")).alias("support"), zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), zero(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
    )


def probability_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    return df.groupBy(probability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def ranked(df: DataFrame, score: str, y: str) -> DataFrame:
    """Distinct scores, best first, with running counts of positives and of rows."""
    levels = df.groupBy(score).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    return cut(running(levels, [], [F.desc(score)], {"tp": F.col("pos"), "seen": F.col("n")}))


def auc_and_ap(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row: auc with ties averaged, and average precision; null if one class is absent."""
    r = ranked(df, score, y)
    total = r.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    neg, below = F.col("n") - F.col("pos"), (F.col("all_n") - F.col("all_pos")) - (F.col("seen") - F.col("tp"))
    total = total.toDF("all_pos", "all_n")
    one = r.join(F.broadcast(total)).agg(  # one row
        F.sum(F.col("pos") * (below + neg / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.first("all_pos").alias("all_pos"), F.first("all_n").alias("all_n")
    )
    return one.select(F.try_divide(F.col("u"), F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))).alias("auc"), F.try_divide(F.col("s"), F.col("all_pos")).alias("ap"))


def log_factorial(n: Column) -> Column:
    """ln(n!) of small counts."""
    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(0.0), lambda a, k: a + F.when(k > 1, F.log(k.cast("double"))).otherwise(0.0))


def gate(name: str, ok: Column, value: Column, limit: float) -> Column:
    status = F.when(value.isNull(), "deferred").when(ok, "pass").otherwise("fail")
    return F.struct(F.lit(name).alias("gate"), status.alias("status"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"))


def strictly_rising(values: Column, gap: float = 1e-6) -> Column:
    """An array of thresholds, each at least `gap` above the one before."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, F.greatest(x, F.element_at(a, -1) + gap)).otherwise(x))))  # a handful


def category_report(df: DataFrame, group: str, actual: str, pred: str, classes: int) -> DataFrame:
    """A row per group: n, macro_f1, weighted_f1, elevated_recall, false_alarms, over_one, critical_recall and supported, from one count per cell."""
    hits = df.groupBy(group, actual, pred).agg(F.count("*").alias("n"))
    a, p, n = F.col(actual), F.col(pred), F.col("n")
    total = lambda ok: F.coalesce(F.sum(F.when(ok, n)), F.lit(0))
    f1 = [F.coalesce(F.try_divide(2 * total((a == k) & (p == k)), total(a == k) + total(p == k)), F.lit(0.0)) for k in range(classes)]
    weighted = sum((total(a == k) * f for k, f in enumerate(f1)), F.lit(0.0)) / F.sum(n)
    share = lambda top, low: F.try_divide(total(top & low), total(low))
    return hits.groupBy(group).agg(
        F.sum(n).alias("n"), (sum(f1, F.lit(0.0)) / classes).alias("macro_f1"), weighted.alias("weighted_f1"), share(p >= 2, a >= 2).alias("elevated_recall"), share(a < 2, p >= 2).alias("false_alarms"),
        (total(F.abs(a - p) > 1) / F.sum(n)).alias("over_one"), share(p >= 3, a >= 3).alias("critical_recall"), (total(a >= 2) >= 100).alias("supported"),
    )
