"""Tasks whose share doesn't grow with the table, and values that are found once per row."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindling.operators import isotonic, ranks, shared


def test_quantiles_of_counted_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    counted = rows.groupBy("k", "v").agg(F.count("*").alias("n"))
    wanted = {"a": (0.5, "linear"), "b": (0.9, "higher")}
    assert sorted(ranks.quantiles(rows, ["k"], "v", wanted).collect()) == sorted(ranks.quantiles(counted, ["k"], "v", wanted, "n").collect())


def test_partitions_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    assert shared.dealt(spark.range(1000), 1000, ["id"]).rdd.getNumPartitions() == 10


def test_draws_and_windows_are_dealt(spark):
    for name in ("monte_carlo_categories", "hourly_rain_of_mixed_windows"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_interpolation_looks_once(spark):
    df = spark.createDataFrame([(0.1, [(0.0, 0.0), (1.0, 2.0)]), (-1.0, [(0.0, 0.5)]), (None, [(0.0, 0.5)]), (3.0, [(0.0, 0.5), (1.0, 2.0)])], "x double, c array<struct<x:double,y:double>>")
    out = df.select(isotonic.interpolated(F.col("x"), F.col("c")).alias("y"))
    assert [r.y for r in out.collect()] == [0.2, 0.5, None, 2.0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1


def test_station_files_hold_many_stations(spark, monkeypatch, tmp_path):
    from kindling.plans import files

    monkeypatch.setattr(files, "shared_dir", lambda s: str(tmp_path / "out"))
    entry.queries()["station_series_with_lags"](spark, "/root/testdata/sf0.001")
    assert len(list((tmp_path / "out").glob("*.txt"))) == 1
