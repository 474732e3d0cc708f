"""Streams in event time against folds and joins over the whole table."""

import os
from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindling.operators import folds
from kindling.streaming import ordered

EVENTS = "/root/testdata/sf0.001/events.parquet"


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def put(rows, path, number):
    """One file, later than those before."""
    rows.coalesce(1).write.mode("append").parquet(path)
    new = max((f for f in os.scandir(path) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
    os.utime(new.path, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.fixture(scope="module")
def rows(spark):
    e = spark.read.parquet(EVENTS).where("user_id < 40")
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 10).alias("q"), F.lit(0.0).alias("p"))


def closing(spark, rows, days=400):
    return rows.limit(1).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("q"), "p")


def state_of(stream, **options):
    return ordered.folded(stream, "user_id", "ts", ["event_id"], ["q", "p"], (10.0,), folds.moisture(), ["k"], **options)


def whole(rows):
    out = folds.fold(rows, ["user_id"], ["ts", "event_id"], ["q", "p"], (10.0,), folds.moisture(), ["k"])
    return sorted((r.event_id, round(r.k, 9)) for r in out.collect())


def test_any_order_over_five_batches(spark, rows, tmp_path):
    """Rows dealt at random over five batches give the states of one fold in order; a stopped stream goes on from its checkpoint."""
    at = lambda n: str(tmp_path / n)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(5)))
    for i in range(5):
        put(dealt.where(F.col("part") == i).drop("part"), at("in"), i)
        if i == 2:
            assert ordered.run_available(state_of(source(spark, at("in"), rows.schema), late="60 days"), at("out"), at("cp")) == 0
            assert spark.read.parquet(at("out")).isEmpty()
    put(closing(spark, rows), at("in"), 9)
    assert ordered.run_available(state_of(source(spark, at("in"), rows.schema), late="60 days"), at("out"), at("cp")) == 0
    got = sorted((r.event_id, round(r.k, 9)) for r in spark.read.parquet(at("out")).where("user_id >= 0").collect())
    assert got == whole(rows) and len(got) > 200


def test_rows_that_come_too_late_are_counted(spark, rows, tmp_path):
    """Days arrive in order but one, which is put off beyond the delay. What counts is the watermark that the batch before was folded up to."""
    at = lambda n: str(tmp_path / n)
    day = F.dayofmonth("ts")
    for i, part in enumerate([rows.where(day <= 9), rows.where((day >= 11) & (day <= 20)), rows.where(day > 20), rows.where(day == 10), closing(spark, rows)]):
        put(part, at("in"), i)
    dropped = ordered.run_available(state_of(source(spark, at("in"), rows.schema), late="2 days"), at("out"), at("cp"))
    got = sorted((r.event_id, round(r.k, 9)) for r in spark.read.parquet(at("out")).where("user_id >= 0").collect())
    assert dropped == rows.where(day == 10).count() > 0
    assert got == whole(rows.where(day != 10))


def test_a_silent_key_is_forgotten(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    t = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    data = [(1, 0, 0, 30.0), (1, 1, 1, 30.0), (1, 60, 2, 30.0), (2, 0, 3, 30.0), (2, 20, 4, 30.0), (None, 1, 5, 1.0)]
    rows = spark.createDataFrame([(k, t(h), i, q, 0.0) for k, h, i, q in data], "user_id long, ts string, event_id long, q double, p double").withColumn("ts", F.to_timestamp("ts"))
    put(rows, at("in"), 0)
    put(closing(spark, rows), at("in"), 1)
    ordered.run_available(state_of(source(spark, at("in"), rows.schema), late="1 hour", idle=timedelta(hours=24)), at("out"), at("cp"))
    k = {r.event_id: r.k for r in spark.read.parquet(at("out")).collect()}
    assert k[2] == k[0] == k[3] and k[1] > k[0] and k[4] > k[3] and 5 not in k


@pytest.mark.parametrize("before, after", [("30 MINUTES", "30 MINUTES"), ("3 HOURS", "0 MINUTES")])
def test_two_streams_by_an_interval(spark, tmp_path, before, after):
    """The nearest, or the latest, of one stream for each row of another, both in disorder over batches; none is null."""
    at = lambda n: str(tmp_path / n)
    e = spark.read.parquet(EVENTS).select((F.col("user_id") % 3).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    runs, seen = e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'click'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("click_id"))
    for i in range(3):
        for name, x in (("a", runs), ("b", seen)):
            put(x.where(F.pmod(F.xxhash64(x.columns[2]), F.lit(3)) == i), at(name), i)
    put(runs.limit(1).withColumns({"ts": F.to_timestamp(F.lit("2030-01-01")), "event_id": F.lit(-1).cast("long")}), at("a"), 9)
    put(seen.limit(1).withColumns({"seen": F.to_timestamp(F.lit("2030-01-01")), "click_id": F.lit(-1).cast("long")}), at("b"), 9)
    pairs = ordered.interval_join(source(spark, at("a"), runs.schema), source(spark, at("b"), seen.schema), "user_id", "ts", "seen", before, after, "60 days")
    pairs = pairs.select("_at", "user_id", "event_id", "click_id", F.unix_micros("_seen").alias("seen_us"))
    gap = F.abs(F.unix_micros("_at") - F.col("seen_us"))
    assert ordered.run_available(ordered.best(pairs, ["event_id"], [gap, F.col("seen_us"), F.col("click_id")], ["click_id"]), at("out"), at("cp")) == 0
    got = sorted((r.event_id, r.click_id or -9) for r in spark.read.parquet(at("out")).where("event_id >= 0").collect())
    width = {"30 MINUTES": 1_800_000_000, "3 HOURS": 10_800_000_000, "0 MINUTES": 0}
    left, right = [r for r in runs.selectExpr("*", "unix_micros(ts) us").collect()], [r for r in seen.selectExpr("*", "unix_micros(seen) us").collect()]
    want = []
    for r in left:
        found = [(abs(r.us - s.us), s.us, s.click_id) for s in right if s.user_id == r.user_id and r.us - width[before] <= s.us <= r.us + width[after]]
        want.append((r.event_id, min(found)[2] if found else -9))
    assert got == sorted(want) and 0 < sum(c == -9 for _, c in want) < len(want)


def test_rows_of_a_call_are_held_as_one():
    """The store is asked through a socket, row by row: a thousand rows of a key are one entry, and come back as they were."""
    entries, woken = [], []
    fold = ordered._Fold(["at_us", "event_id", "q"], (0.0,), lambda state, q: (state[0] + (q or 0.0),), None, ["key", "at_us", "event_id", "q", "k"], 2)
    held = SimpleNamespace(exists=lambda: bool(entries), get=lambda: iter(entries), clear=entries.clear, put=lambda x: entries.__setitem__(slice(None), x), appendValue=entries.append, appendList=entries.extend)
    value = SimpleNamespace(exists=lambda: False, get=lambda: None, clear=lambda: None, update=lambda x: None)
    fold.init(SimpleNamespace(getListState=lambda *a: held, getValueState=lambda *a: value, registerTimer=woken.append, deleteTimer=lambda ms: None))
    n = 1000
    rows = pd.DataFrame({"at_us": [1000 * (n - i) for i in range(n)], "event_id": pd.array([None, *range(1, n)], "object"), "q": [float("nan"), *([1.0] * (n - 1))]})
    list(fold.handleInputRows((1,), iter([rows]), None))
    assert len(entries) == 1 and woken == [1]
    (out,) = fold.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 600), None)
    assert len(out) == 600 and out.k.tolist() == [float(i) for i in range(1, 601)] and len(entries) == 1
    (out,) = fold.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: n), None)
    assert out.at_us.tolist() == [1000 * i for i in range(601, n + 1)] and out.event_id.isna().tolist() == [False] * 399 + [True] and not entries
