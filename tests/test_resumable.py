"""Batches that are killed, taken up again, fail and are tried again; a log with two writers."""

import os

import pytest
from pyspark.sql import functions as F

from kindling.sources import resumable
from kindling.sources.log import Conflict, Log

SCHEMA = "source string, v long"


class Killed(BaseException):
    """As a signal: not an Exception, so nothing handles it."""


class Job:
    """Sources of some numbers each, and work that may be told to die or to fail."""

    def __init__(self, spark, tmp_path, n=8):
        self.spark, self.at = spark, str(tmp_path)
        self.log = Log(spark, f"{self.at}/log", resumable.STATES)
        os.makedirs(f"{self.at}/in")
        self.seen, self.batches, self.die_at, self.raises, self.bad = [], 0, None, False, {}
        for i in range(n):
            self.put(i, range(i))

    def put(self, i, values, part=""):
        with open(f"{self.at}/in/run_{i:02d}{part}.txt", "w") as f:
            f.write("#\n" + "".join(f"{v}\n" for v in values))

    def files(self):
        return resumable.listed(self.spark, f"{self.at}/in", r"run_(\d+)")

    def work(self, files):
        self.batches += 1
        if self.batches == self.die_at:
            raise Killed
        if self.raises:
            raise OSError("no connection")
        mine = {r.source: r.path for r in files.collect()}
        self.seen += sorted({*mine})
        lines = self.spark.read.text(sorted({r.path for r in files.collect()})).where("value <> '#'").select(F.regexp_extract("_metadata.file_name", r"run_(\d+)", 1).alias("source"), F.col("value").cast("long").alias("v"))
        bad = [(s, *e) for s, e in self.bad.items() if s in mine]
        return lines, self.spark.createDataFrame(bad, "source string, error_class string, error string") if bad else None

    def run(self, contract="1", **options):
        self.seen, self.batches = [], 0
        return resumable.run(self.log, self.files(), self.work, f"{self.at}/out", contract, **({"per_batch": 2} | options))

    def rows(self, **options):
        return sorted((r.source, r.v) for r in resumable.results(self.log, f"{self.at}/out", SCHEMA, **options).collect())

    def states(self):
        return {r.source: r for r in self.log.latest("source").collect()}


@pytest.fixture
def job(spark, tmp_path):
    return Job(spark, tmp_path)


WHOLE = [(f"{i:02d}", v) for i in range(8) for v in range(i)]


def test_a_killed_run_is_taken_up(job):
    job.die_at = 3
    with pytest.raises(Killed):
        job.run()
    first, states = set(job.seen), job.states()
    assert 0 < len(first) < 8
    assert {s for s, r in states.items() if r.status == "complete"} == first and {r.status for r in states.values()} == {"complete", "pending"}
    assert job.rows() == [r for r in WHOLE if r[0] in first]
    job.die_at = None
    assert job.run() == {"complete": 8 - len(first), "failed": 0, "skipped": len(first), "given_up": 0}
    assert set(job.seen).isdisjoint(first) and job.rows() == WHOLE
    assert {(r.status, r.attempts) for r in job.states().values()} == {("complete", 1)} and job.states()["00"].rows == 0


def test_changed_sources_alone_are_done_again(job):
    job.run()
    assert job.run() == {"complete": 0, "failed": 0, "skipped": 8, "given_up": 0} and not job.seen
    job.put(3, [70])
    job.put(5, [9], part="_more")
    job.put(8, [1, 1])
    assert job.run()["complete"] == 3 and sorted(job.seen) == ["03", "05", "08"]
    assert job.rows() == sorted([r for r in WHOLE if r[0] != "03"] + [("03", 70), ("05", 9), ("08", 1), ("08", 1)])
    assert job.run(contract="2")["complete"] == 9 and len(job.rows()) == len(WHOLE) - 3 + 4
    os.remove(f"{job.at}/in/run_08.txt")
    assert job.run(contract="2")["skipped"] == 8
    assert ("08", 1) in job.rows() and ("08", 1) not in job.rows(pruned=job.files())


def test_failures_by_class(job):
    job.bad = {"02": ("permanent", "no header"), "04": ("retry", "cut short")}
    assert job.run() == {"complete": 6, "failed": 2, "skipped": 0, "given_up": 0}
    assert not {"02", "04"} & {s for s, _ in job.rows()}
    for n in (2, 3):
        assert job.run()["failed"] == 1 and job.seen == ["04"]
        assert job.states()["04"].attempts == n
    assert job.run() == {"complete": 0, "failed": 0, "skipped": 6, "given_up": 2}
    job.bad = {}
    job.put(2, [5])
    job.put(4, [6])
    assert job.run()["complete"] == 2 and job.rows() == sorted([r for r in WHOLE if r[0] not in ("02", "04")] + [("02", 5), ("04", 6)])
    assert job.states()["04"].attempts == 1


def test_a_batch_that_raises_is_tried_again(job):
    job.raises = True
    assert job.run()["failed"] == 8 and job.rows() == []
    assert {(r.error_class, "no connection" in r.error) for r in job.states().values()} == {("retry", True)}
    job.raises = False
    assert job.run()["complete"] == 8 and job.rows() == WHOLE
    assert {r.attempts for r in job.states().values()} == {2}


def test_two_writers(spark, tmp_path):
    log = Log(spark, str(tmp_path), "k long, v string")
    assert log.version() == 0 and log.read().count() == 0
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    assert log.commit(rows("a"), 0) == 1
    with pytest.raises(Conflict):
        Log(spark, str(tmp_path), "k long, v string").commit(rows("b"), 0)
    assert [(r.v, r.version) for r in log.read().collect()] == [("a", 1)]
    log.commit(rows("c"), 1)
    assert log.version() == 2 and log.latest("k").first().v == "c"
