"""Readers of observations and forecasts, and checks of what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions.times import hour_half_even

#: First name present wins.
ALIASES = {"fm": ["fuel_moisture_set_1", "fuel_moisture"], "rh": ["relative_humidity_set_1", "relative_humidity"], "wind": ["wind_speed_set_1", "wind_speed"]}
STATION = "array<struct<STID:string,STATE:string,LATITUDE:string,LONGITUDE:string,OBSERVATIONS:map<string,array<string>>>>"


def station_json(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """A row per station and time; files that don't parse are skipped, bad numbers are null, the last of repeated times stays.

    Series shorter than the times are padded with nulls.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"STATION {STATION}", {"mode": "PERMISSIVE"}).alias("j")).where("j.STATION is not null")
    s = parsed.select(F.explode("j.STATION").alias("s")).select("s.*")
    if state:
        s = s.where(F.col("STATE") == state)
    series = {n: F.coalesce(*(F.try_element_at("OBSERVATIONS", F.lit(a)) for a in names)) for n, names in ALIASES.items()}
    at = s.select("STID", F.col("LATITUDE").try_cast("double").alias("lat"), F.col("LONGITUDE").try_cast("double").alias("lon"), F.posexplode(F.try_element_at("OBSERVATIONS", F.lit("date_time"))).alias("i", "t"), *(v.alias(k) for k, v in series.items()))
    rows = at.select("STID", "lat", "lon", "i", F.try_to_timestamp("t").alias("time"), *(F.get(F.col(k), F.col("i")).try_cast("double").alias(k) for k in ALIASES)).where("time is not null")
    return rows.groupBy("STID", "time").agg(F.max_by(F.struct("lat", "lon", *ALIASES), "i").alias("x")).select("STID", "time", "x.*")


def tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV and Parquet files under a folder, columns aligned by name."""
    options = {"recursiveFileLookup": "true"}
    csv = spark.read.schema(schema).options(header=True, pathGlobFilter="*.csv", **options).csv(path)
    return csv.unionByName(spark.read.schema(schema).options(pathGlobFilter="*.parquet", **options).parquet(path), allowMissingColumns=True)


def index_ranges(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Byte ranges of the messages of index files (number:offset:...:name:level:...) that match, neighbours joined to blocks."""
    from pyspark.sql import Window

    parts = F.split("value", ":")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parts[0].cast("int").alias("n"), parts[1].cast("long").alias("first"), F.array_join(F.slice(parts, 4, 2), ":").alias("name"))
    by = Window.partitionBy("file").orderBy("n")
    wanted = lines.withColumn("last", F.lead("first").over(by) - 1).withColumn("place", F.row_number().over(by)).where(F.col("name").rlike(pattern))
    block = wanted.withColumn("block", F.col("place") - F.row_number().over(by))
    return block.groupBy("file", "block").agg(F.min("first").alias("first"), F.when(F.count("last") == F.count("*"), F.max("last")).alias("last"), F.count("*").alias("messages")).drop("block")


def typed_csv(spark: SparkSession, path: str, schema: str, manifest: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header by a given schema. With a manifest of checksums by file name, other or changed files are refused."""
    if manifest is not None:
        verify(spark, f"{path}/*.csv", manifest)
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def verify(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    """Fails unless the files are those of the manifest, byte for byte."""
    seen = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in checksum(spark, path).collect()}  # a manifest's files
    if wrong := sorted(n for n in seen.keys() | manifest.keys() if seen.get(n) != manifest.get(n)):
        raise ValueError(f"files and manifest differ: {', '.join(wrong)}")


def forecast_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A row per station and forecast of files {run_date, stations: {id: {lat, lon, forecasts: [{...}]}}}; files that don't parse are skipped."""
    kind = f"run_date STRING, stations MAP<STRING, STRUCT<lat: DOUBLE, lon: DOUBLE, forecasts: ARRAY<STRUCT<{fields}>>>>"
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j")).where("j.stations is not null")
    s = j.select("j.run_date", F.explode("j.stations").alias("stid", "s")).select("run_date", "stid", "s.lat", "s.lon", F.explode("s.forecasts").alias("f"))
    return s.select("run_date", "stid", "lat", "lon", "f.*")


def observations_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """stid, hour, temp_c and n from files whose root is a list of observations, one of them, or a map from station to list; with `lines`, each line is such a root. Fahrenheit is told by its unit.

    Times are rounded to the hour, halves to the even one, and values averaged by it.
    """
    one = "STRUCT<stid: STRING, time: STRING, temp: DOUBLE, unit: STRING>"
    raw = spark.read.text(path, wholetext=not lines).select(F.trim("value").alias("v")).select("v", F.from_json("v", f"MAP<STRING, ARRAY<{one}>>").alias("m"))
    root = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"ARRAY<{one}>")).when(F.get_json_object("v", "$.stid").isNotNull(), F.array(F.from_json("v", one)))
    listed = raw.withColumn("root", root)
    flat = listed.where("root is not null").select(F.explode("root").alias("o")).select("o.*")
    keyed = listed.where("root is null and m is not null").select(F.explode("m").alias("id", "list")).select("id", F.explode("list").alias("o")).select(F.coalesce("o.stid", "id").alias("stid"), "o.time", "o.temp", "o.unit")
    rows = flat.unionByName(keyed).withColumn("at", F.try_to_timestamp("time")).where("at is not null")
    temp = F.when(F.col("unit") == "F", (F.col("temp") - 32) * 5 / 9).otherwise(F.col("temp"))
    return rows.groupBy("stid", hour_half_even(F.col("at")).alias("hour")).agg(F.avg(temp).alias("temp_c"), F.count("*").alias("n"))


def discovered(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """path, bytes and the part of each file's name that the pattern finds; files without it are left out."""
    listing = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    return listing.withColumn("found", F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))).where("found is not null")


def lead_problems(df: DataFrame, run: str, lead: str, value: str, first: int, last: int) -> DataFrame:
    """Per run: whether anything is finite, whether its leads cover first to last, and whether an amount is negative."""
    fine = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.groupBy(run).agg(F.bool_or(fine).alias("finite"), ((F.min(lead) <= first) & (F.max(lead) >= last)).alias("covered"), F.coalesce(F.bool_or(F.col(value) < 0), F.lit(False)).alias("negative"))


def checksum(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def problems(df: DataFrame, required: list[str], not_negative: list[str] = ()) -> list[str]:
    """What is wrong with a grid: missing variables, nothing finite, negative amounts."""
    missing = [c for c in required if c not in df.columns]
    found = [f"missing: {c}" for c in missing]
    have = [c for c in required if c not in missing]
    checks = {f"nothing finite: {c}": F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) == 0 for c in have}
    checks |= {f"negative: {c}": F.count_if(F.col(c) < 0) > 0 for c in not_negative if c in df.columns}
    if checks:
        one = df.agg(*(v.alias(f"_{i}") for i, v in enumerate(checks.values()))).first()
        found += [k for i, k in enumerate(checks) if one[i]]
    return found
