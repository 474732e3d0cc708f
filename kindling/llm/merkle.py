"""A Merkle manifest of a table: a leaf per row, a tree per source, a tree over the sources.

Levels are made by windows: nodes of one group that share a parent index stand in one window
partition, whose ordered, full-frame collect_list is both the parent's preimage and, without the node itself,
its siblings; parents are deduplicated before the next level. A window holds `fan` nodes, so
a source of any share spreads over all tasks, and each level has a third of the rows of the
one below. Places of leaves come from range partitions. Proofs are put together from the root
down: each level's nodes take their parents' path, which ends at the leaves, so the long paths of a level
are shuffled for its parents only. Digests are 32 bytes on the way and hex where they are hashed.

Edge cases: null is a source of its own, first in order, and null fields are `-`. Empty texts are `0:`. Null
doc_ids come first within their source; rows of one doc_id are ordered by leaf, so rows that repeat have equal
leaves, in neighbouring places. A very long text is hashed whole in its own row. A source of one row has its leaf as subroot, one source alone has its
subroot as root. An empty table gives an empty result. Columns that aren't hashed are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm.common import counted_join, cut, pick
from kindling.operators.ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: A path: by level, the siblings left and right of a node, as digests one after another.
PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """`-` for null, else the length in UTF-8, `:` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hashed(*digests: Column) -> Column:
    """The digest of digests as hex text."""
    return F.unhex(F.sha2(F.concat(*(F.lower(F.hex(d)) for d in digests)), 256))


def joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))


def levels(leaves: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """The levels of each group's tree, and grp, depth (its number of levels) and root of each group.

    `leaves` has grp, idx from 0, n (how many the group has) and digest. A level holds the nodes of groups that have
    more than one there, with their siblings left and right; node idx has node idx div `fan` of the next level as parent.
    """
    own = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made, roots, nodes = [], [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.where("n = 1").select("grp", F.lit(len(made)).alias("depth"), F.col("digest").alias("root")))
        if most <= 1:
            return made, cut(reduce(DataFrame.unionByName, roots))
        level = nodes.where("n > 1").withColumns({"parent": F.expr(f"idx div {fan}"), "at": F.expr(f"cast(idx % {fan} AS int)")})
        level = level.withColumn("run", F.collect_list("digest").over(own))
        sides = {"left": joined(F.slice("run", F.lit(1), F.col("at"))), "right": joined(F.slice("run", F.col("at") + 2, F.lit(fan)))}
        made.append(cut(level.withColumns({"up": hashed(joined(F.col("run"))), **sides}).drop("run")))
        nodes = made[-1].where("at = 0").select("grp", F.col("parent").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("up").alias("digest"))
        most = -(-most // fan)


def descend(leaves: DataFrame, made: list[DataFrame], tops: DataFrame) -> DataFrame:
    """`leaves` with the path to the root of their tree, continued by the path that `tops` has for the root, and what else it has.

    `tops` has grp, depth and path of each group.
    """
    more = [c for c in tops.columns if c not in ("grp", "depth", "path")]

    def step(level: DataFrame, upper: DataFrame, keep: list[str]) -> DataFrame:
        over = upper.select("grp", F.col("idx").alias("parent"), F.col("path").alias("rest"), *more)
        return level.join(over, ["grp", "parent"]).select(*keep, F.concat(F.array(F.struct("left", "right")), "rest").alias("path"), *more)

    upper = None
    for k in range(len(made), 0, -1):  # the nodes of level k, which has the roots of trees of that depth
        nodes = tops.where(F.col("depth") == k).select("grp", F.lit(0).cast("long").alias("idx"), "path", *more)
        upper = cut(nodes if upper is None else nodes.unionByName(step(made[k], upper, ["grp", "idx"])))
    alone = leaves.where("n = 1").join(tops.where("depth = 0").drop("depth"), "grp").select(*leaves.columns, "path", *more)
    return alone if upper is None else alone.unionByName(step(made[0], upper, leaves.columns))


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, digest (its leaf), spare (the leaf without the line feeds of its text), path, subroot and root; digests are binary."""
    rows = pick(docs, *FIELDS)
    others = [F.col(c) for c in FIELDS[:-1]]
    rows = rows.select("doc_id", F.struct(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source")).alias("grp"), leaf(*others, F.col("text")).alias("digest"), leaf(*others, F.translate("text", "\n", "")).alias("spare"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    placed = ranked(rows, ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")], "idx").withColumn("idx", F.col("idx") - 1).drop("row")
    leaves = cut(counted_join(placed, sizes, ["grp"], rows.count()))
    made, subroots = levels(leaves, fan)
    sources = ranked(subroots, [], [F.col("grp")], "idx").select(F.lit(True).alias("grp"), (F.col("idx") - 1).alias("idx"), F.lit(subroots.count()).cast("long").alias("n"), F.col("root").alias("digest"), F.col("grp").alias("of"), F.col("depth").alias("levels"))
    sources = cut(sources)
    above, root = levels(sources, fan)
    tops = descend(sources, above, root.withColumn("path", F.expr(f"cast(array() AS {PATH})")))
    tops = cut(tops.select(F.col("of").alias("grp"), F.col("levels").alias("depth"), "path", F.col("digest").alias("subroot"), "root"))
    return descend(leaves, made, tops).drop("grp", "idx", "n")


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, in hex."""
    return F.sha2(F.lower(F.hex(joined(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"])))))), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a path makes of a leaf."""
    return F.aggregate(path, start, lambda a, s: hashed(s["left"], a, s["right"]))


def checked(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Each row's proof, and what it says of a copy of the table in which some rows lost their line feeds: those whose id has an even crc32."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest(docs, fan).withColumn("folded", folded(F.col("path"), F.when(tampered, F.col("spare")).otherwise(F.col("digest"))))
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof(F.col("path")).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
