"""A registry of models as a versioned log: registered, promoted, rolled back; assets resolved by checksum.

Every action is a row, and a commit holds one row for each of any number of models; what is served is read off the rows. A commit is made from the
state that its writer saw: of two writers at once one gets a Conflict and nothing of it counts. Releases are major.minor.patch, candidates
carry -beta.N. An asset stays where it is and counts only as long as its bytes have the checksum that was recorded.

Edge cases: a model twice in one call, an unknown channel or bump, a promotion without a candidate and an asset that is missing or changed are refused, and the log stays
as it was. Null models are refused. An empty table commits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindling.operators.shared import cut
from kindling.sources.log import Log

ASSETS = "array<struct<role:string,path:string,sha256:string>>"
ACTIONS = f"model string, action string, channel string, release string, performance double, assets {ASSETS}"
STABLE, BETA = "stable", "beta"
#: Actions of a model that its history shows.
HISTORY = 20
#: The release that an older registry's model starts from.
BASELINE = "1.0.0"


class Refused(ValueError):
    """The registry doesn't allow this."""


def _refuse(rows: DataFrame, *whys: tuple[Column, str], of: str = "model") -> None:
    """Raises Refused where a condition holds for a row; conditions that come to null don't hold."""
    why = F.coalesce(*(F.when(c, w) for c, w in whys))
    bad = rows.select(why.alias("_why"), F.col(of).cast("string").alias("_of")).where("_why is not null").limit(5).collect()  # for the message
    if bad:
        raise Refused("; ".join(f"{r[0]}: {r[1]}" for r in bad))


def _unnamed() -> list[tuple[Column, str]]:
    return [(F.col("model").isNull(), "models need names"), (F.count("*").over(Window.partitionBy("model")) > 1, "twice in one call")]


def checksums(spark: SparkSession, assets: DataFrame) -> DataFrame:
    """assets(..., path) with `now`, the SHA-256 of the file; null where there is none. Each file is read by the task that it falls to."""
    paths = [r[0] for r in assets.select("path").distinct().where("path is not null").collect()]  # names of model files, a handful for each model resolved
    if not paths:
        return assets.withColumn("now", F.lit(None).cast("string"))
    of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    there = [p for p in paths if of(p).getFileSystem(conf).exists(of(p))]
    if not there:
        return assets.withColumn("now", F.lit(None).cast("string"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    files = spark.read.format("binaryFile").load(there).select(plain(F.col("path")).alias("_path"), F.sha2("content", 256).alias("now")).distinct()
    return assets.join(files, plain(F.col("path")) == F.col("_path"), "left").drop("_path")


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path, ACTIONS)

    def state(self) -> DataFrame:
        """A row per model: model, stable and beta (structs, null without one), previous (the stable one before), and how many actions are in the history."""
        rows = self.log.read()
        entry = F.struct("release", "performance", "assets", "version")
        stable = F.col("channel") == STABLE
        # a stable row ends the candidate before it; of the actions only the newest two stable rows and the newest candidate are kept
        x = rows.withColumn("_rank", F.sum(stable.cast("int")).over(Window.partitionBy("model").orderBy(F.desc("version"))))
        x = x.groupBy("model").agg(
            F.max_by(F.when(stable & (F.col("_rank") == 1), entry), F.when(stable & (F.col("_rank") == 1), F.col("version"))).alias("stable"),
            F.max_by(F.when(~stable & (F.col("_rank") == 0), entry), F.when(~stable & (F.col("_rank") == 0), F.col("version"))).alias("beta"),
            F.max_by(F.when(stable & (F.col("_rank") == 2), entry), F.when(stable & (F.col("_rank") == 2), F.col("version"))).alias("previous"),
            F.least(F.count("*"), F.lit(HISTORY)).cast("long").alias("kept"),
        )
        return x

    def history(self) -> DataFrame:
        """The last actions of each model, HISTORY of them at most, the newest first by place."""
        by = Window.partitionBy("model").orderBy(F.desc("version"))
        return self.log.read().withColumn("place", F.row_number().over(by)).where(F.col("place") <= HISTORY)

    def register(self, candidates: DataFrame) -> int:
        """Records candidates(model, channel, bump, performance, assets: array of (role, path)) under their next releases; the log's version.

        `bump` is major, minor or patch of the stable release (0.0.0 without one); a candidate of the same base as the one there is its next -beta.N.
        """
        after = self.log.version()
        new = cut(candidates.select(F.col("model").cast("string").alias("model"), "channel", "bump", F.col("performance").cast("double").alias("performance"), F.col("assets").cast("array<struct<role:string,path:string>>").alias("assets")))
        known = lambda c, *values: F.coalesce(F.col(c).isin(*values), F.lit(False))
        _refuse(new, *_unnamed(), (~known("channel", STABLE, BETA), "unknown channel"), (~known("bump", "major", "minor", "patch"), "unknown bump"))
        x = new.join(self.state().select("model", F.col("stable.release").alias("_at"), F.col("beta.release").alias("_beta")), "model", "left")
        part = lambda i: F.coalesce(F.get(F.split("_at", "[.]"), F.lit(i)), F.lit("0")).cast("int")
        up = lambda name, i, below: F.when(F.col("bump") == name, part(i) + 1).when(F.col("bump").isin(*below), 0).otherwise(part(i))
        x = x.withColumn("_base", F.concat_ws(".", up("major", 0, []), up("minor", 1, ["major"]), up("patch", 2, ["major", "minor"])))
        last = F.when(F.startswith(F.col("_beta"), F.concat("_base", F.lit("-beta."))), F.element_at(F.split("_beta", "[.]"), -1).cast("int")).otherwise(0)
        release = F.when(F.col("channel") == STABLE, F.col("_base")).otherwise(F.concat("_base", F.lit("-beta."), (F.coalesce(last, F.lit(0)) + 1).cast("string")))
        return self._commit(self._checked(x.select("model", F.lit("register").alias("action"), "channel", release.alias("release"), "performance", "assets")), after)

    def promote(self, models: DataFrame) -> int:
        """The candidates of models(model, and release where a certain one is meant) become stable, without their suffix."""
        after = self.log.version()
        new = models.select(F.col("model").cast("string").alias("model"), (F.col("release") if "release" in models.columns else F.lit(None)).cast("string").alias("_meant"))
        x = cut(new.join(self.state(), "model", "left"))
        _refuse(x, *_unnamed(), (F.col("beta").isNull(), "no candidate"), (F.col("_meant") != F.col("beta.release"), "another candidate is there"))
        self._held(x.select("model", F.explode("beta.assets").alias("a")).select("model", "a.*"))
        return self._commit(x.select("model", F.lit("promote").alias("action"), F.lit(STABLE).alias("channel"), F.regexp_replace("beta.release", "-beta[.][0-9]+$", "").alias("release"), F.col("beta.performance").alias("performance"), F.col("beta.assets").alias("assets")), after)

    def roll_back(self, models: DataFrame) -> int:
        """The stable release before the present one is stable again."""
        after = self.log.version()
        x = cut(models.select(F.col("model").cast("string").alias("model")).join(self.state(), "model", "left"))
        _refuse(x, *_unnamed(), (F.col("previous").isNull(), "no release before"))
        self._held(x.select("model", F.explode("previous.assets").alias("a")).select("model", "a.*"))
        return self._commit(x.select("model", F.lit("roll_back").alias("action"), F.lit(STABLE).alias("channel"), "previous.release", "previous.performance", "previous.assets"), after)

    def migrate(self, old: DataFrame) -> int:
        """Models of an older registry, old(model, performance, assets), start from BASELINE; those that the log has stay as they are, so it may be run again."""
        after = self.log.version()
        new = old.select(F.col("model").cast("string").alias("model"), F.col("performance").cast("double").alias("performance"), F.col("assets").cast("array<struct<role:string,path:string>>").alias("assets"))
        new = cut(new.join(self.log.read().select("model").distinct(), "model", "left_anti"))
        _refuse(new, *_unnamed())
        return self._commit(self._checked(new.select("model", F.lit("migrate").alias("action"), F.lit(STABLE).alias("channel"), F.lit(BASELINE).alias("release"), "performance", "assets")), after)

    def resolve(self, models: DataFrame, channel: str = STABLE) -> DataFrame:
        """model, release, role, path and sha256 of what is served; refused where a model has none or an asset isn't what was recorded."""
        x = cut(models.select(F.col("model").cast("string").alias("model")).distinct().join(self.state().select("model", F.col(channel).alias("_e")), "model", "left"))
        _refuse(x, (F.col("_e").isNull(), f"nothing {channel}"))
        assets = x.select("model", "_e.release", F.explode("_e.assets").alias("a")).select("model", "release", "a.*")
        self._held(assets)
        return assets

    def _checked(self, rows: DataFrame) -> DataFrame:
        """With the checksums of the assets; one that isn't there is refused."""
        rows = cut(rows)
        if rows.where(F.size("assets") > 0).isEmpty():
            return rows.withColumn("assets", F.array().cast(ASSETS))
        found = cut(checksums(self.spark, rows.select("model", F.explode("assets").alias("a")).select("model", "a.*")))
        _refuse(found, (F.col("now").isNull(), "no such asset"), of="path")
        of = found.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("role", "path", F.col("now").alias("sha256")))).alias("assets"))  # a model's files
        return rows.drop("assets").join(of, "model", "left").withColumn("assets", F.coalesce("assets", F.array().cast(ASSETS)))

    def _held(self, assets: DataFrame) -> None:
        _refuse(checksums(self.spark, assets), (F.col("now").isNull() | (F.col("now") != F.col("sha256")), "missing or changed asset"), of="path")

    def _commit(self, rows: DataFrame, after: int) -> int:
        rows = cut(rows)
        return after if rows.isEmpty() else self.log.commit(rows, after)
