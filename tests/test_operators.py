import json

import pytest
from pyspark.sql import functions as F

from kindling.functions import scores, weather
from kindling.operators import folds, geo, graph, ranks, shared, splits
from kindling.sources import sinks, stations
from kindling.streaming import observations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rule(spark):
    c = lambda *v: one(spark, weather.danger_category(*map(F.lit, v)))
    assert c(6.9, 19.9, 25.0) == 4 and c(float("nan"), 20.0, 25.0) is None and c(15.0, 5.0, 50.0) == 0 and c(8.0, 24.0, 5.0) == 2


def test_units(spark):
    assert [one(spark, weather.precip_mm(F.lit(v), F.lit(u))) for v, u in ((2.0, "kg m-2"), (0.002, "m"), (1.0, "inch"))] == [2.0, 2.0, 25.4]
    with pytest.raises(Exception):
        one(spark, weather.precip_mm(F.lit(1.0), F.lit("furlong")))


def test_score_renormalises(spark):
    none = F.lit(None).cast("double")
    f = dict.fromkeys(scores.WEIGHTS, none)
    assert one(spark, scores.weighted_score(f)) is None
    assert one(spark, scores.weighted_score(f | {"rh": F.lit(0.3)})) == pytest.approx(0.3 / scores.CEILING)


def test_drought_without_rain_rises(spark):
    df = spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("d"), F.lit(30.0).alias("t"), F.lit(0.0).alias("p"))
    got = [r.s for r in folds.fold(df, ["k"], ["d"], ["t", "p"], (0.0,), folds.drought(1000.0), ["s"]).orderBy("d").collect()]
    assert got == sorted(got) and 0 < got[0] < got[-1] < 800


def test_components(spark):
    nodes = spark.range(10).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (7, 8)], "u long, v long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}


def test_time_holdout(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (3, 3), (3, 8), (4, 9)], "g int, t int")
    assert {r.g: r.side for r in splits.time_holdout(df, "g", "t", 0.3).collect()} == {1: "train", 2: "train", 3: "dropped", 4: "test"}


def test_station_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"STATION": [{"STID": "A", "STATE": "MO", "LATITUDE": "38", "LONGITUDE": "-92", "OBSERVATIONS": {"date_time": ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"], "fuel_moisture": ["9", "x"], "relative_humidity_set_1": ["40"]}}]}))
    (tmp_path / "b.json").write_text("not json")
    got = sorted((r.STID, r.fm, r.rh) for r in stations.station_json(spark, str(tmp_path), "MO").orderBy("time").collect() if r.fm) + [r.fm for r in stations.station_json(spark, str(tmp_path)).orderBy("time").collect()]
    assert got == [("A", 9.0, 40.0), 9.0, None]


def test_content_hash_ignores_order(spark):
    a = spark.range(20).select("id", (F.col("id") * 2).alias("v"))
    assert sinks.content_hash(a).first() == sinks.content_hash(a.orderBy(F.desc("id")).select("v", "id")).first()


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    s = observations.hourly(observations.source(spark, str(tmp_path / "in"), events.schema), ["event_type"], "ts", "value")
    assert observations.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp")).agg(F.sum("n")).first()[0] == events.count()


def test_sieve_and_counted_join(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), "id")
    keys = rows.where("k % 3 = 0").groupBy("k").agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([(9999, 0)], "k long, n long"))
    out = shared.sieved(rows, F.xxhash64("k"), keys, F.xxhash64("k"))
    assert out.count() == 5000 and out.where("k % 3 = 0 and not maybe").isEmpty() and out.where("maybe").count() < 1800
    want = rows.join(keys, "k").count()
    for cool in (100, 7, 0):
        monkeypatch.setattr(shared, "COOL_ROWS", cool)
        assert shared.counted_join(rows, keys, ["k"], 5000).count() == want and shared.counted_join(rows, keys, ["k"], 5000, how="left").count() == 5000


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, x) for x in range(1001, 1400)]
    got = {r.node: r.root for r in graph.linked(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1400)}
    assert graph.linked(spark.createDataFrame([], "u long, v long")).count() == 0


def test_moisture_stream_carries_its_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, 20.0 if i < 3 else 5.0) for i in range(6)], "k long, t long, level double")
    for part in (rows.where("t < 3"), rows.where("t >= 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = observations.moisture(observations.source(spark, str(tmp_path / "in"), rows.schema), "k", "t", "level")
        out = observations.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    state, want = 10.0, []
    for x in [20.0] * 3 + [5.0] * 3:
        state = folds.moisture()((state,), x, 0.0)[0]
        want.append(state)
    assert sorted(r.fm for r in out.collect()) == pytest.approx(sorted([want[2], want[5]]))


@pytest.mark.parametrize("lat, lon", [(0.0, 179.95), (89.7, 10.0), (-71.3, -179.9), (45.0, 0.0)])
def test_no_pair_is_lost_at_any_latitude(spark, lat, lon):
    import math

    import numpy as np

    draw = np.random.default_rng(1)
    pts = [(i, float(np.clip(lat + draw.normal(0, 0.4), -90, 90)), float((lon + draw.normal(0, 2 if abs(lat) < 80 else 90) + 180) % 360 - 180)) for i in range(60)]
    df = spark.createDataFrame(pts, "k long, lat double, lon double")
    got = {(r.k, r.r_k) for r in geo.within_radius(df, df, 30.0).where("k < r_k").collect()}

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * weather.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a, b) <= 30.0}


def test_quantiles_and_ranks_equal_numpy(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    rows = [(g, float(v)) for g in range(3) for v in draw.integers(0, 40, 57 + g)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "v", {"a": (0.3, "linear"), "b": (0.8, "higher")}).collect()}
    for g in range(3):
        v = [x for k, x in rows if k == g]
        assert got[g].a == pytest.approx(np.quantile(v, 0.3)) and got[g].b == np.quantile(v, 0.8, method="higher")
    n = spark.range(23).select(F.col("id"), F.xxhash64("id").alias("h"))
    tiles = ranks.ranked(n, [], [F.col("h")]).select(ranks.tile(F.col("rank"), F.lit(23), 10).alias("t")).groupBy("t").count().collect()
    assert sorted((r.t, r["count"]) for r in tiles) == [(t + 1, len(x)) for t, x in enumerate(np.array_split(np.arange(23), 10))]


def test_files_that_differ_from_their_manifest_are_refused(spark, tmp_path):
    spark.range(3).write.csv(str(tmp_path / "x"), header=True)
    told = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in stations.checksum(spark, str(tmp_path / "x") + "/*.csv").collect()}
    assert stations.typed_csv(spark, str(tmp_path / "x"), "id LONG", told).count() == 3
    with pytest.raises(ValueError):
        stations.typed_csv(spark, str(tmp_path / "x"), "id LONG", dict.fromkeys(told, "0"))
