"""A versioned log: numbered commits of rows, each seen whole or not at all, on any store that Spark writes to.

The rows of a commit are a Parquet folder; the commit is a small file named by its version, written elsewhere and then renamed, which the
store refuses where that version exists. Of two writers who start from the same version one is refused and changes nothing.
What a stopped writer leaves without a commit is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Log:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.at = self.jvm.org.apache.hadoop.fs.Path
        self.files = self.at(self.path).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)

    def _commits(self) -> dict[int, str]:
        folder = self.at(f"{self.path}/commits")
        found = self.files.listStatus(folder) if self.files.exists(folder) else []
        return {int(n): f"{self.path}/commits/{n}" for n in (f.getPath().getName() for f in found) if n.isdigit()}

    def version(self) -> int:
        """The last commit; 0 before the first."""
        return max(self._commits(), default=0)

    def commit(self, rows: DataFrame, after: int) -> int:
        """Adds `rows` as the version behind `after`, the one that they were made from; Conflict if it is there by now."""
        name, version = uuid.uuid4().hex, after + 1
        typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema))
        typed.write.parquet(f"{self.path}/rows/{name}")
        new, last = self.at(f"{self.path}/new/{name}"), self.at(f"{self.path}/commits/{version:012d}")
        out = self.files.create(new, False)
        out.write(bytearray(json.dumps({"rows": name}).encode()))
        out.close()
        self.files.mkdirs(self.at(f"{self.path}/commits"))
        never = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = never
        try:
            self.context.rename(new, last, options)
        except Exception as e:
            if self.files.exists(last):
                raise Conflict(f"version {version} of {self.path} was made by another writer") from e
            raise
        return version

    def read(self) -> DataFrame:
        """All rows with their version."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], self.schema).withColumn("version", F.lit(0).cast("long"))
        text = self.spark.read.text([*commits.values()]).select(F.get_json_object("value", "$.rows").alias("_of"), F.element_at(F.split("_metadata.file_path", "/"), -1).cast("long").alias("version"))
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/*").withColumn("_of", F.element_at(F.split("_metadata.file_path", "/"), -2))
        return rows.join(F.broadcast(text), "_of").drop("_of")  # one small row a commit

    def latest(self, *keys: str) -> DataFrame:
        """The newest row of each key."""
        return self.read().groupBy(*keys).agg(F.max_by(F.struct("*"), "version").alias("_r")).select("_r.*")
