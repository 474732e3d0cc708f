"""Which run of its source each member of an ensemble takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(anchors: DataFrame, members: list[tuple[str, str, int]], runs: DataFrame, oldest: int, latency: Column | None = None) -> DataFrame:
    """A row per anchor and member: anchor, member, source, cycle (null without one), age in hours and status.

    anchors(anchor), runs(source, cycle, ...), with times in whole hours; members are the configuration, (member, source, offset) in order. In that order each
    takes the newest run of its source that is at most its anchor plus its offset, at most `oldest` hours before the anchor, and not taken by
    a member before it: no run is used twice for an anchor. With `latency`, a column over runs, a run counts only once cycle + latency <= anchor, as it would have live.
    Status is target (the newest one allowed), stepped_back (an older one, as that was taken), or unavailable. Null times are left out; times that repeat count once.

    Runs are filed by windows of `oldest` hours, so an anchor meets only those of its own time, and are folded once per anchor and source.
    """
    far = max([0, *(o for _, _, o in members)])
    ready = F.col("cycle") + (latency if latency is not None else F.lit(0))
    r = runs.where("source is not null and cycle is not null").groupBy("source", F.col("cycle").cast("long").alias("cycle")).agg(F.min(ready).alias("_ready"))
    anchors = anchors.select(F.col("anchor").cast("long").alias("anchor")).where("anchor is not null").distinct()
    slot = lambda t: F.floor(t / F.lit(oldest))
    near = anchors.withColumn("_t", F.explode(F.sequence(slot(F.col("anchor") - oldest), slot(F.col("anchor") + far))))
    late = F.col("_ready") <= F.col("anchor") if latency is not None else F.lit(True)
    met = near.join(r.withColumn("_t", slot(F.col("cycle"))), "_t").where(late & F.col("cycle").between(F.col("anchor") - oldest, F.col("anchor") + far))
    lists = met.groupBy("anchor", "source").agg(F.sort_array(F.collect_list("cycle"), False).alias("_c"))  # a source's runs in that time
    own = {s: [(m, o) for m, of, o in members if of == s] for s in dict.fromkeys(s for _, s, _ in members)}
    config = [F.struct(F.lit(s).alias("source"), F.array(*(F.struct(F.lit(m).alias("member"), F.lit(o).alias("offset")) for m, o in mine)).alias("_m")) for s, mine in own.items()]
    each = anchors.select("anchor", F.inline(F.array(*config))).join(lists, ["anchor", "source"], "left").withColumn("_c", F.coalesce("_c", F.array().cast("array<bigint>")))
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<struct<member:string,cycle:bigint,stepped:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        allowed = F.filter("_c", lambda c: c <= F.col("anchor") + x["offset"])
        mine = F.get(F.filter(allowed, lambda c: ~F.array_contains(acc["taken"], c)), F.lit(0))
        row = F.struct(x["member"].alias("member"), mine.alias("cycle"), (mine < F.get(allowed, F.lit(0))).alias("stepped"))
        return F.struct(F.when(mine.isNull(), acc["taken"]).otherwise(F.array_append(acc["taken"], mine)).alias("taken"), F.array_append(acc["out"], row).alias("out"))

    each = each.select("anchor", "source", F.explode(F.aggregate("_m", start, step)["out"]).alias("o"))
    status = F.when(F.col("o.cycle").isNull(), "unavailable").when(F.col("o.stepped"), "stepped_back").otherwise("target")
    return each.select("anchor", F.col("o.member").alias("member"), "source", F.col("o.cycle").alias("cycle"), (F.col("anchor") - F.col("o.cycle")).alias("age"), status.alias("status"))
