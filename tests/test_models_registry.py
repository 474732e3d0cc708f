"""A registry with two writers, changed assets, promotions and roll-backs."""

import pytest
from pyspark.sql import functions as F

from kindling.sources import models
from kindling.sources.log import Conflict
from kindling.sources.models import Refused, Registry

NEW = "model string, channel string, bump string, performance double, assets array<struct<role:string,path:string>>"


@pytest.fixture
def made(spark, tmp_path):
    return Registry(spark, str(tmp_path / "log"))


def asset(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def of(made, *rows):
    return made.spark.createDataFrame([(m, c, b, p, a) for m, c, b, p, a in rows], NEW)


def named(made, *names):
    return made.spark.createDataFrame([(n,) for n in names], "model string")


def state(made):
    return {r.model: (r.stable and r.stable.release, r.beta and r.beta.release, r.previous and r.previous.release) for r in made.state().collect()}


def test_releases(made):
    made.register(of(made, ("a", "beta", "patch", 1.0, []), ("b", "stable", "major", 2.0, [])))
    assert state(made) == {"a": (None, "0.0.1-beta.1", None), "b": ("1.0.0", None, None)}
    made.register(of(made, ("a", "beta", "patch", 1.5, []), ("b", "beta", "minor", 2.0, [])))
    made.register(of(made, ("a", "beta", "minor", 1.5, [])))
    assert state(made) == {"a": (None, "0.1.0-beta.1", None), "b": ("1.0.0", "1.1.0-beta.1", None)}
    made.promote(named(made, "a", "b"))
    assert state(made) == {"a": ("0.1.0", None, None), "b": ("1.1.0", None, "1.0.0")}
    made.roll_back(named(made, "b"))
    assert state(made)["b"] == ("1.0.0", None, "1.1.0")
    made.register(of(made, ("b", "beta", "patch", 2.0, [])))
    assert state(made)["b"][1] == "1.0.1-beta.1"
    assert [(r.action, r.place) for r in made.history().where("model = 'b'").orderBy("place").collect()] == [("register", 1), ("roll_back", 2), ("promote", 3), ("register", 4), ("register", 5)]


def test_history_ends_at_its_length(made, monkeypatch):
    monkeypatch.setattr(models, "HISTORY", 3)
    for _ in range(5):
        made.register(of(made, ("a", "beta", "patch", 1.0, [])))
    assert made.history().count() == 3 and made.state().first().kept == 3 and state(made)["a"][1] == "0.0.1-beta.5"


def test_refusals_leave_the_log_alone(made, tmp_path):
    made.register(of(made, ("a", "beta", "patch", 1.0, [])))
    twice, none = of(made, ("b", "beta", "patch", 1.0, []), ("b", "beta", "patch", 1.0, [])), of(made, (None, "beta", "patch", 1.0, []))
    for bad in (twice, none, of(made, ("b", "gamma", "patch", 1.0, [])), of(made, ("b", None, "patch", 1.0, [])), of(made, ("b", "beta", "huge", 1.0, [])), of(made, ("b", "beta", "patch", 1.0, [("model", str(tmp_path / "no"))]))):
        with pytest.raises(Refused):
            made.register(bad)
    for bad in (named(made, "b"), made.spark.createDataFrame([("a", "9.9.9-beta.1")], "model string, release string")):
        with pytest.raises(Refused):
            made.promote(bad)
    with pytest.raises(Refused):
        made.roll_back(named(made, "a"))
    assert made.log.version() == 1 and made.register(of(made).where("false")) == 1


def test_two_writers_at_once(made, monkeypatch):
    made.register(of(made, ("a", "beta", "patch", 1.0, [])))
    other = Registry(made.spark, made.log.path)
    checked = other._checked

    def late(rows):
        made.register(of(made, ("a", "beta", "patch", 2.0, [])))
        return checked(rows)

    monkeypatch.setattr(other, "_checked", late)
    with pytest.raises(Conflict):
        other.register(of(made, ("a", "beta", "patch", 3.0, [])))
    assert made.state().first().beta.performance == 2.0


def test_assets_by_checksum(made, tmp_path):
    w, s = asset(tmp_path, "w.bin", "weights"), asset(tmp_path, "s.json", "{}")
    made.register(of(made, ("a", "beta", "patch", 1.0, [("model", w), ("static", s)])))
    got = made.resolve(named(made, "a"), "beta").orderBy("role").collect()
    assert [(r.role, r.path, r.release) for r in got] == [("model", w, "0.0.1-beta.1"), ("static", s, "0.0.1-beta.1")] and all(len(r.sha256) == 64 for r in got)
    with pytest.raises(Refused):
        made.resolve(named(made, "a"))
    made.promote(named(made, "a"))
    asset(tmp_path, "s.json", "{1}")
    with pytest.raises(Refused, match="s.json"):
        made.resolve(named(made, "a"))
    asset(tmp_path, "s.json", "{}")
    (tmp_path / "w.bin").unlink()
    with pytest.raises(Refused, match="w.bin"):
        made.resolve(named(made, "a"))


def test_migration_can_be_repeated(made, tmp_path):
    w = asset(tmp_path, "w.bin", "weights")
    made.register(of(made, ("new", "stable", "minor", 1.0, [])))
    old = made.spark.createDataFrame([("old", 0.5, [("model", w)]), ("new", 0.1, [])], "model string, performance double, assets array<struct<role:string,path:string>>")
    made.migrate(old)
    made.migrate(old)
    assert state(made) == {"new": ("0.1.0", None, None), "old": ("1.0.0", None, None)} and made.log.version() == 2
    assert made.resolve(named(made, "old")).count() == 1
