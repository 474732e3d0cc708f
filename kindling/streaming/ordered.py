"""Streams in event time: states that take late rows in the right order, and joins of two streams by an interval.

`folded` holds a key's rows until the watermark has passed them, so rows that arrive in any order, in any batch,
are folded in the order of their times; the state is the same as that of one fold over the whole table. Rows behind
the watermark come too late for that and are dropped by Spark; `Dropped` counts them. What is held grows with the
rows of one key within the watermark's delay only. A key that is silent for long can be forgotten.

Edge cases: rows without key or time are left out; rows with equal times follow the columns of `order`; rows that
repeat are folded each; null values reach the step as None.
"""

from __future__ import annotations

import pickle
import threading
from collections.abc import Callable
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """Rows held by key, due once the watermark has passed their time; one timer a key, at the first time held or when it is to be forgotten.

    The store is asked through a socket, row by row, so the rows of a call are held as one, packed.
    """

    def __init__(self, columns: list[str], start: tuple, step: Callable, idle_ms: int | None, out: list[str], lead: int):
        self.columns, self.start, self.step, self.idle_ms, self.out, self.lead = columns, start, step, idle_ms, out, lead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.state = handle.getValueState("state", ", ".join(f"s{i} double" for i in range(len(self.start))) + ", last_us long")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        """The key's one timer, at `ms` or where it is, whatever comes first."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or ms < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        for b in rows:
            own = list(zip(*([None if gone else v for v, gone in zip(b[c].tolist(), b[c].isna().tolist())] for c in self.columns)))
            self.held.appendValue((pickle.dumps(own, pickle.HIGHEST_PROTOCOL),))
            self._wake(-(-min(r[0] for r in own) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, rows = timerValues.getCurrentWatermarkInMs() * 1000, [r for (packed,) in self.held.get() for r in pickle.loads(packed)] if self.held.exists() else []
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        self.timer.clear()
        state, last = self.start, None
        if self.state.exists():
            *state, last = self.state.get()
        state, out = tuple(state), []
        for r in sorted(due, key=lambda r: [(v is not None, v) for v in r]):
            if self.idle_ms is not None and last is not None and r[0] - last > self.idle_ms * 1000:
                state = self.start
            state, last = self.step(state, *r[self.lead :]), r[0]
            out.append((*key, *r, *state))
        if out:
            self.state.update((*map(float, state), last))
        if rest:
            self.held.put([(pickle.dumps(rest, pickle.HIGHEST_PROTOCOL),)])
            self._wake(-(-min(r[0] for r in rest) // 1000))
        else:
            self.held.clear()
            if self.idle_ms is not None and last is not None:
                if passed - last > self.idle_ms * 1000:
                    self.state.clear()
                else:
                    self._wake(last // 1000 + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, at: str, order: list[str], columns: list[str], start: tuple, step: Callable, names: list[str], late: str, idle: timedelta | None = None) -> DataFrame:
    """key, at (microseconds), order, columns and the state after each row as doubles, once the watermark has passed it.

    `at` is a timestamp; rows more than `late` behind the latest are dropped. step(state, *values) gives the next state, a tuple of floats.
    After a silence longer than `idle` a key begins anew from `start`.
    """
    timed = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    rows = timed.select(key, "_at", F.unix_micros("_at").alias("at_us"), *order, *columns)
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in [key, "at_us", *order, *columns]) + ", " + ", ".join(f"{n} double" for n in names)
    idle_ms = None if idle is None else int(idle.total_seconds() * 1000)
    fold = _Fold(["at_us", *order, *columns], start, step, idle_ms, [key, "at_us", *order, *columns, *names], 1 + len(order))
    return rows.groupBy(key).transformWithStateInPandas(fold, out, "Append", "EventTime")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, before: str, after: str, late: str, how: str = "leftOuter") -> DataFrame:
    """Each row of `left` with the rows of `right` whose `seen` lies from `before` its `at` to `after` it; both are streams.

    Spark keeps a row only as long as the watermarks leave it a partner. Columns of `right` but the key come with it; without a partner they are
    null once the watermark has passed, with `how` leftOuter.
    """
    a = left.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    b = right.withColumnRenamed(key, "_key").withColumn("_seen", F.col(seen).cast("timestamp")).withWatermark("_seen", late)
    near = F.expr(f"_seen >= _at - INTERVAL {before} AND _seen <= _at + INTERVAL {after}")
    return a.join(b, (F.col(key) == F.col("_key")) & near, how).drop("_key")


def best(pairs: DataFrame, columns: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row for each row of the left side of an interval join, with the partner that comes first by `order`; null without one.

    A streaming aggregate by the left row's time, so a result leaves once that time can have no more partners.
    """
    found = F.when(F.col(keep[0]).isNotNull(), F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *keep))
    rows = pairs.select("_at", *columns, found.alias("_found"))
    return rows.groupBy("_at", *columns).agg(F.min("_found").alias("_found")).select(*columns, *(F.col("_found")[k].alias(k) for k in keep))


class Dropped(StreamingQueryListener):
    """Rows that queries dropped because the watermark had passed them."""

    def __init__(self):
        self.rows, self.ended = 0, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.set()


@contextmanager
def _rocks(spark: SparkSession):
    """States with timers need this store; the setting is put back."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Takes all that is there and appends what is final to files in `path`; the number of rows that came too late.

    A later run with the same checkpoint goes on from there, whatever ended the one before.
    """
    spark, dropped = stream.sparkSession, Dropped()
    spark.streams.addListener(dropped)
    try:
        with _rocks(spark):
            query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        dropped.ended.wait(60)
    finally:
        spark.streams.removeListener(dropped)
    return dropped.rows
