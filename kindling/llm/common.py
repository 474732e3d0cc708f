"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.operators.shared import BROADCAST_ROWS, counted_join, cut, shared_dir, sieved

__all__ = ["bounded", "counted_join", "cut", "flat", "labelled", "let", "pick", "position", "remainder", "shared_dir", "sieved", "table", "words"]

#: Words are runs of anything but these six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Columns renamed by position, and where each original name went.

    Extra columns can't clash then, whatever they are called. Names are looked up
    exactly first and without regard to case next.
    """
    names = df.columns
    where: dict[str, Column] = {}
    for i, name in enumerate(names):
        where.setdefault(name.lower(), F.col(f"c_{i}"))
    for i, name in reversed(list(enumerate(names))):
        where[name] = F.col(f"c_{i}")
    return df.toDF(*(f"c_{i}" for i in range(len(names)))), where


def position(names: list[str], name: str) -> int:
    """Where flat() finds a name: exactly first, without regard to case next."""
    return names.index(name) if name in names else [n.lower() for n in names].index(name)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns."""
    frame, where = flat(df)
    return frame.select(*(where[n].alias(n) for n in names))


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where `rows`, which the caller has counted, is small enough; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled(labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """About `rows` (doc_id, y) at most, chosen by hash among labels that may be learned from; all without `rows`.

    Rows whose remainder is 2 are never learned from. An id labelled more than once gets
    its largest label. A share is taken, so that the count holds in expectation.
    """
    own = (
        pick(labels, "doc_id", label)
        .toDF("doc_id", "y")
        .where("doc_id is not null and y is not null")
        .where(remainder(F.col("doc_id")) != 2)
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    if rows is None:
        return own
    share = rows / max(rows, own.count())
    return own.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
