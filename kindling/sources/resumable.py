"""Batches over sources that can be stopped and taken up again: fingerprints, a manifest with states, fragments.

A source is one or more files. Its fingerprint is made of their names, sizes and times and of the contract (the parameters and
version of the work); a source is done again only if it changes. The manifest is a log of states: pending, complete, failed with a
class. `retry` is tried again in later runs, up to a number of attempts; `permanent` only once the source has
changed. A batch's rows are a new fragment, and count only once its commit is there: a run that is killed
loses the batch it was at, no other, and leaves no row twice.

Edge cases: a source that yields no rows is complete with 0 rows; one that is gone keeps its last rows unless `pruned`; a source
that failed after it had been complete has no rows any more, as they were of other files. Without sources nothing is committed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.operators.shared import cut
from kindling.sources.log import Log

STATES = "source string, fingerprint string, status string, error_class string, error string, attempts int, rows long, fragment string"
RETRY, PERMANENT = "retry", "permanent"
#: What becomes of a source in the next run.
DONE, RUN, GIVEN_UP = "done", "run", "given_up"


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """source, path, length and time of the files whose name has the pattern, whose first group is the source. Their contents aren't read; an empty file isn't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    source = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    return files.select(source.alias("source"), "path", "length", F.unix_micros("modificationTime").alias("time")).where("source <> ''")


def fingerprinted(files: DataFrame, contract: str) -> DataFrame:
    """source and fingerprint, of all its files and the contract."""
    own = F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"), F.col("time").cast("string"))
    return files.groupBy("source").agg(F.sha2(F.concat_ws("\n", F.lit(contract), F.sort_array(F.collect_list(own))), 256).alias("fingerprint"))


def planned(sources: DataFrame, log: Log, attempts: int = 3) -> DataFrame:
    """source, fingerprint, attempts so far and what to do: done, run or given_up."""
    old = log.latest("source").select("source", F.col("fingerprint").alias("_was"), "status", "error_class", F.col("attempts").alias("_n"))
    x = sources.join(old, "source", "left")
    same = F.col("_was").eqNullSafe(F.col("fingerprint"))
    todo = F.when(same & (F.col("status") == "complete"), DONE).when(same & (F.col("status") == "failed") & ((F.col("error_class") == PERMANENT) | (F.col("_n") >= attempts)), GIVEN_UP).otherwise(RUN)
    return x.select("source", "fingerprint", F.when(same, F.col("_n")).otherwise(0).alias("attempts"), todo.alias("todo"))


def run(log: Log, files: DataFrame, work: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], folder: str, contract: str, per_batch: int = 100, attempts: int = 3) -> dict[str, int]:
    """Does what is to be done, batch by batch; how many sources were complete, failed, skipped and given up.

    work(files of a batch) gives rows with their `source`, and None or (source, error_class, error) of sources
    that failed, whose rows are dropped. If it raises an Exception the whole batch has failed, to be tried again.
    """
    plan = cut(planned(fingerprinted(files, contract), log, attempts))
    count = {r.todo: r["count"] for r in plan.groupBy("todo").count().collect()}  # three at most
    out = {"complete": 0, "failed": 0, "skipped": count.get(DONE, 0), "given_up": count.get(GIVEN_UP, 0)}
    if not count.get(RUN):
        return out
    batches = math.ceil(count[RUN] / per_batch)
    todo = plan.where(F.col("todo") == RUN).select("source", "fingerprint", "attempts", F.pmod(F.xxhash64("source"), F.lit(batches)).alias("batch"))
    version = log.version()
    version = log.commit(_states(todo, F.lit("pending"), F.col("attempts")), version)
    for i in range(batches):
        own = todo.where(F.col("batch") == i)
        version = log.commit(cut(_batch(log, own, files.join(own.select("source"), "source", "left_semi"), work, f"{folder}/{uuid.uuid4().hex}")), version)
    ended = log.latest("source").join(todo.select("source"), "source", "left_semi").groupBy("status").count().collect()
    return out | {r.status: r["count"] for r in ended}


def _states(sources: DataFrame, status, attempts, error_class=None, error=None, rows=None, fragment=None) -> DataFrame:
    of = lambda x: F.lit(None) if x is None else x
    return sources.select("source", "fingerprint", of(status).alias("status"), of(error_class).alias("error_class"), of(error).alias("error"), attempts.alias("attempts"), of(rows).alias("rows"), of(fragment).alias("fragment"))


def _batch(log: Log, own: DataFrame, files: DataFrame, work: Callable, path: str) -> DataFrame:
    """The states that the sources of a batch end in; their rows are written to `path`."""
    tried = F.col("attempts") + 1
    try:
        rows, problems = work(files)
        rows.write.parquet(path)
        made = log.spark.read.schema(rows.schema).parquet(path).groupBy("source").agg(F.count("*").alias("_rows"))
        bad = (problems if problems is not None else log.spark.createDataFrame([], "source string, error_class string, error string")).groupBy("source").agg(F.max(F.struct("error_class", "error")).alias("_bad"))
        x = own.join(made, "source", "left").join(bad, "source", "left")
        fine = F.col("_bad").isNull()
        return cut(_states(x, F.when(fine, "complete").otherwise("failed"), tried, F.col("_bad.error_class"), F.col("_bad.error"), F.when(fine, F.coalesce("_rows", F.lit(0))), F.when(fine, F.lit(path.rsplit("/", 1)[-1]))))
    except Exception as e:  # another run may get further; anything but an Exception ends the run here
        return _states(own, F.lit("failed"), tried, F.lit(RETRY), F.lit(str(e)[:500]))


def results(log: Log, folder: str, schema: str, pruned: DataFrame | None = None) -> DataFrame:
    """The rows of all sources that are complete, each from its newest fragment; with `pruned`, only of sources that it has."""
    states = log.latest("source").where("status = 'complete'").select("source", F.col("fragment").alias("_fragment"))
    if pruned is not None:
        states = states.join(pruned.select("source").distinct(), "source", "left_semi")
    states = cut(states)
    fragments = [r[0] for r in states.where("_fragment is not null").select("_fragment").distinct().collect()]  # one a batch
    if not fragments:
        return log.spark.createDataFrame([], schema)
    rows = log.spark.read.schema(schema).parquet(*(f"{folder}/{f}" for f in fragments)).withColumn("_fragment", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return rows.join(states, ["source", "_fragment"], "left_semi").drop("_fragment")
