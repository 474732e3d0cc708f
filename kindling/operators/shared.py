"""Tables written between steps, and joins whose hot keys don't meet in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; its rows hold some 100 bytes at most.
BROADCAST_ROWS = 500_000
#: Rows of one key that a shuffle may always bring to a task.
COOL_ROWS = 100
#: Rows of a task where a table is dealt by its size.
TASK_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder, removed at its end; a cluster is refused.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(shared_dir, "own", None)
        if root is None:
            root = shared_dir.own = tempfile.mkdtemp(prefix="kindling-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/kindling-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back.

    Lineage and size estimates start anew there, a lost executor costs no recomputation, and
    values such as partition ids stay what they were when first computed.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """df by `keys` in as many partitions as its `rows`, which the caller has counted, ask for, so that a task's share stays the same at any size."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def counted_join(rows: DataFrame, side: DataFrame, keys: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """`rows` with the columns of `side`, which has each key once and in `n` how many rows of `rows` it meets.

    `total` is the count of `rows`. Keys that meet more than total / BROADCAST_ROWS rows are fewer than
    BROADCAST_ROWS by arithmetic: they are broadcast, and their rows stay where they are. The other
    keys, and all that meet COOL_ROWS or fewer, are joined by a shuffle that brings at most that many rows of one key to a task.
    """
    limit = max(total // BROADCAST_ROWS, COOL_ROWS)
    values = [c for c in side.columns if c not in keys]
    hot = side.where(F.col(n) > limit).withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.where("_hot is null").select(*rows.columns).join(side.where(F.col(n) <= limit), keys, how)
    return met.where("_hot").select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))


#: Bits of a sieve, as a power of two.
SIEVE_BITS = 24


def sieved(rows: DataFrame, h: Column, keys: DataFrame, of_key: Column) -> DataFrame:
    """`rows` with `maybe`, false where the hash `h` certainly isn't among the hashes `of_key` of `keys`.

    A bitmap of 2**SIEVE_BITS bits is broadcast, however many keys there are: 262,144 longs at most.
    It never errs the other way; as it fills up, more rows are maybe.
    """
    slot = lambda x: F.pmod(x, F.lit(1 << SIEVE_BITS))
    bits = keys.select(slot(of_key).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 AS int))")).alias("_bits"))
    met = rows.withColumn("_slot", slot(h)).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(bits), "_word", "left")
    return met.withColumn("maybe", F.coalesce(F.expr("shiftright(_bits, cast(_slot & 63 AS int)) & 1 = 1"), F.lit(False))).select(*rows.columns, "maybe")
