"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Keys are range-sorted within their source: the key's top
bits are its range, so a source of any share spreads over many ranges. Word counts are
summed by range, the ranges' prefix sums give each range its start, and a running sum
inside the one range where a source's budget ends finds the exact cut. A budget above the
source's size takes whole epochs first. The last document taken is cut to the words that
the budget still has.

Edge cases: a null or empty text has size 0 and takes 0. Null is a source of its own, last in
order. Rows that repeat doc_id and text share one key; if the cut falls on them each takes
an equal part. A very long text counts with all its words, and is cut only where a budget ends in it. A source of size 0 has target 0. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm.common import WORD_GAP, cut, flat, pick, position, words

WEIGHTS = (5, 2, 1)
CAP = 3
#: A source's keys fall into 2**RANGE_BITS ranges.
RANGE_BITS = 12
SEED = 11


def _keyed(df: DataFrame) -> DataFrame:
    key = F.xxhash64(F.lit(SEED), "doc_id", F.coalesce("text", F.lit("")))
    return df.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source, from its total (source, source_size).

    Sources in code point order, null last, weigh as `weights` repeats. All targets sum to all
    sizes; one that would pass `cap` times its source stops there and the rest is shared
    again by weight. That level is found in one pass over the sources sorted by the ratio
    at which each meets its cap. The table has one row per source, not per document.
    """
    weight = F.array(*map(F.lit, map(float, weights)))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.element_at(weight, (order % len(weights) + 1).cast("int"))).withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    free = F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    s = s.withColumn("level", free / F.sum("w").over(after)).withColumn("place", F.row_number().over(by))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    return s.withColumn("found", found).select("source", "source_size", F.least(cap * F.col("source_size").cast("double"), F.col("found") * F.col("w")).alias("target"))


def cuts(light: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size and target, whole epochs, and the key at which the last one ends.

    A row takes its size once per epoch, again if its key is below `last`, and at most
    `share` words if it is equal. `light` has source, size and key.
    """
    ranged = light.where("size > 0").withColumn("bucket", F.shiftright("key", 64 - RANGE_BITS))
    totals = cut(ranged.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    goal = goal.withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    goal = cut(goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    # one row per source and range
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0)))
    rest = goal.select(F.col("source").alias("s"), "rest")
    last = starts.join(rest, F.col("source").eqNullSafe(F.col("s"))).where("start <= rest and rest < start + words")
    last = last.select("s", F.col("bucket").alias("b"), "start", "rest")
    # only the ranges in which a budget ends are sorted row by row
    ended = ranged.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ended = ended.groupBy("source", "bucket", "key", "start", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    run = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ended = ended.withColumn("upto", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    ended = ended.where("upto <= rest and rest < upto + words").select(F.col("source").alias("s"), F.col("key").alias("last"), F.expr("(rest - upto) div copies").alias("share"))
    return goal.join(ended, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "last", "share")


def _taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    ends = ends.withColumnRenamed("source", "s")
    once = F.when(F.col("key") < F.col("last"), F.col("size")).when(F.col("key") == F.col("last"), F.least("size", "share")).otherwise(F.lit(0))
    return rows.join(ends, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", once.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target and taken words."""
    light = cut(_keyed(pick(docs, "doc_id", "source", "text")))
    ends = cut(cuts(light, weights, cap))
    return _taken(light, ends).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text of more than `n` words, up to the end of its n-th, blanks as they are."""
    n = n + text.rlike(rf"\A{WORD_GAP}").cast("int")  # an empty piece stands before leading blanks
    rest = F.element_at(F.split(text, WORD_GAP, n + 1), -1)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), rf"{WORD_GAP}\z", "")


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row once per time it is taken, with all its columns.

    The copy at a cut is the beginning of its text up to the end of the last word that the budget has; its
    n_chars, where there is one, follows. Rows that take nothing are gone.
    """
    ends = cut(cuts(cut(_keyed(pick(docs, "doc_id", "source", "text"))), weights, cap))
    frame, at = flat(docs)
    size = F.size(words(at["text"])).cast("long")
    keyed = frame.withColumns({"source": at["source"], "size": size, "key": F.xxhash64(F.lit(SEED), at["doc_id"], F.coalesce(at["text"], F.lit("")))})
    rows = _taken(keyed, ends).where("taken > 0").withColumn("whole", F.col("epochs") + (F.col("part") == F.col("size")).cast("long"))
    partly = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("whole") + partly.cast("long")).cast("int"))))
    short = partly & (F.col("copy") > F.col("whole"))
    text = F.when(short, first_words(at["text"], F.col("part").cast("int"))).otherwise(at["text"])
    out = [F.col(c) for c in frame.columns]
    out[position(docs.columns, "text")] = text
    if "n_chars" in docs.columns:
        out[position(docs.columns, "n_chars")] = F.when(short, F.length(text).cast("long")).otherwise(at["n_chars"])
    return rows.select(*(c.alias(f"o_{i}") for i, c in enumerate(out))).toDF(*docs.columns)
