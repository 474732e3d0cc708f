"""SimHash near-dedup at a similarity of 0.8: wide fingerprints in pigeonhole blocks.

Two texts whose 5-word shingles have a Jaccard similarity of 0.8 differ in about 15 % of their
SimHash bits, some ten of 64: too many for a short fingerprint to share a block that tells
texts apart. Here a fingerprint has 1664 bits. The first 1024 are split into blocks of `bits`, close
pairs share a block, pairs are joined on equal blocks, and the Hamming distance is verified, first on
128 bits that travel with the block and then on all 1664: the more bits, the fewer pairs below 0.8 pass. A pair at 0.8 shares one of 71 blocks
of 16 bits in 99 of 100 cases, at 0.9 nearly always. `bits` grows with the logarithm of the
number of texts so that chance partners per block stay level, and the number of blocks grows
with `bits` so that recall does: further blocks are dealt from permutations of the same 1024.

A pair that passes may still lie below 0.8, and in a group of texts that share a template most do. So a bitmap of
the shingles' hashes goes with each fingerprint, from which follows how many shingles two texts can share at most. Pairs that can't reach 0.8
end there; none at 0.8 does.

What passes is a candidate. It is linked if the two sets of shingles, as 64-bit hashes, have a
Jaccard similarity of 0.8 or more; texts of equal sets are one node.

Groups of copies make no pairs of all their members. First each text is compared with the
smallest of each of its blocks, and in crowded blocks with the member that stands in most company; verified links merge into groups. That is linear. Blocks
whose members are all of one group are done. In the others only members of different groups
meet, so no link that could join two groups is left out, and there is no cap. Blocks of more
than CROWDED members carry whole fingerprints into the join, which makes both tests there.

Blocks of more than DENSE members aren't compared pair by pair. Their members meet by shingles instead: two sets at 0.8 have
so many in common that, each set sorted by how often its shingles occur, the first one they share stands early in both. So each lists
the rarest fifth of its own and meets others there, by place and size; texts that share a template and little else don't list
the template at all. That leaves out no pair at 0.8, whatever its blocks, so pairs of such members are left out of the smaller
blocks. A shingle that very many list is dealt by size and into tiles, so none is one task's work. Of sets near 0.8 that share their rarest shingles
too, the comparisons, though not the rows, still grow with the square.

Edge cases: a null or empty text has no words; texts without words are one node, linked like any other. Texts of equal shingle sets are
one node, so ties between copies are settled by row: of a group the smallest doc_id stays, null last, and of equal ids the
smallest node and row. All shingles of a very long text count. An empty table gives an empty result. Extra columns are kept or ignored as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import BROADCAST_ROWS, counted_join, cut, pick
from kindling.llm.simhash import SEED, one_of_each
from kindling.operators import graph
from kindling.operators.shared import COOL_ROWS

#: The JVM compiles no method of more than 8,000 bytes of code; the test of 28 longs comes near that.
WIDTH, WORDS = 1664, 26
#: Longs of the bitmap of shingles. It tells most of sets of up to some 250 shingles, little of those of more than 1,000.
BITMAP = 16
#: The first bits, which blocks are dealt from.
BLOCKED = 1024
#: Bits that may differ in a candidate: 15.2 % at 0.8, and three standard deviations.
DISTANCE = 296
#: Longs of the sketch, and the bits of it that may differ; three and a half standard deviations above 15.2 %.
SKETCH, SKETCH_DISTANCE = 2, 34
LEAST_BITS, CHUNK, SLICE = 16, 1 << 11, 500
#: Share of bits that differ at a similarity of 0.8, and of such pairs that may share no block.
DIFFERING, MISSED = 0.1515, 0.005
#: Pairs that each node asks for before blocks are joined.
ASKED = 3
#: Members of a block above which whole fingerprints go into its join. Chance brings 16 at most on average; what is found
#: doesn't depend on it, only where the last test of a pair is made.
CROWDED = 24
#: Members of a block above which they meet by shingles, not by blocks; four times what chance brings. What is found doesn't depend on it but
#: for pairs at 0.8 that share no block, which are found as well.
DENSE = 64
#: Texts listed under a shingle above which they are dealt by size and into tiles, and steps of size in which a text grows e-fold.
TILE, STEPS = 256, 40
#: Counts of shingles, by hash, that say which are rare; they only set the order, and this many at most pass through the driver.
SLOTS = 1 << 14
#: The root that stands for those of all members of dense blocks where others meet them; a hash like the nodes.
TOGETHER = -0x61C8864680B583EB
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(WORDS)], np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends, digest = ends[size - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The WIDTH bits of a set of shingles, as bytes of 0 and 1."""
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), CHUNK):
        h = hashes[i : i + CHUNK]
        wide = h[:, None] * _ODD  # one odd multiplier per word, then mixed down
        wide ^= wide >> np.uint64(29)
        wide *= np.uint64(0xBF58476D1CE4E5B9)
        wide ^= wide >> np.uint64(32)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return (2 * ones > len(hashes)).astype(np.uint8)


def shape_of(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set of shingles as longs, how many shingles there are, and how many of them no bit shows."""
    ones = np.zeros(64 * BITMAP, np.uint8)
    ones[hashes % np.uint64(len(ones))] = 1
    return np.concatenate([np.packbits(ones, bitorder="little").view("<i8"), [len(hashes), len(hashes) - ones.sum(dtype=np.int64)]])


def block_bits(rows: int) -> int:
    return max(LEAST_BITS, math.ceil(math.log2(max(2, rows))) - 4)


def tables(bits: int) -> np.ndarray:
    """The places in a fingerprint of the bits of each block, one row a block."""
    n = BLOCKED // bits
    least = max(n, math.ceil(math.log(MISSED) / math.log(1 - (1 - DIFFERING) ** bits)))
    draw = np.random.default_rng(SEED)
    orders = [np.arange(BLOCKED), *(draw.permutation(BLOCKED) for _ in range(math.ceil(least / n) - 1))]
    return np.concatenate([o[: n * bits].reshape(n, bits) for o in orders])[:least]


def fingerprints(docs: DataFrame, bits: int, shingle: int = 5) -> DataFrame:
    """The columns of `docs` but text, node (a hash of the set of shingles), wide (26 longs, then those of shape_of) and keys, the blocks."""
    places, n = tables(bits), len(tables(bits))
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            texts, keep = b.column("text").to_pylist(), [c for c in b.schema.names if c != "text"]
            for i in range(0, len(texts), SLICE):
                own = [shingle_set(t or b"", shingle) for t in texts[i : i + SLICE]]
                all_bits = np.stack([bits_of(h) for h in own])
                packed = np.hstack([np.packbits(all_bits, axis=1, bitorder="little").view("<i8"), np.stack([shape_of(h) for h in own])])
                nodes = [xxhash.xxh64_intdigest(h.tobytes()) for h in own]
                keys = all_bits[:, places].astype(np.int64) @ powers + (np.arange(n, dtype=np.int64) << bits)
                ends = np.arange(len(own) + 1)
                lists = lambda x, k: pa.ListArray.from_arrays(pa.array(ends * k, pa.int32()), pa.array(x.ravel(), pa.int64()))
                columns = [*(b.column(c).slice(i, len(own)) for c in keep), pa.array(np.array(nodes, np.uint64).view(np.int64)), lists(packed, packed.shape[1]), lists(keys, n)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "node", "wide", "keys"])

    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")})
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text") + ", node long, wide array<long>, keys array<long>")


def _differ(a: str, b: str, words: int) -> Column:
    """How many of the first 64 * words bits of two arrays of longs differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))


def _can_reach(a: str, b: str) -> Column:
    """Whether two sets can have a Jaccard similarity of 0.8. What they share is in bits that both have, but for shingles that no bit of their own shows."""
    size, hidden = ([F.get(x, F.lit(WORDS + BITMAP + i)) for x in (a, b)] for i in range(2))
    common = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in range(WORDS, WORDS + BITMAP)), F.lit(0))
    return 9 * F.least(common + F.least(*hidden), *size) >= 4 * (size[0] + size[1])


def _candidates(pairs: DataFrame) -> DataFrame:
    """The distinct (u, v) of pairs (u, v, w1, w2) that can reach 0.8; as an aggregate, so that this test stays out of the joins' own, which would grow too long to be compiled."""
    return pairs.groupBy("u", "v").agg(F.bool_or(_can_reach("w1", "w2")).alias("can")).where("can").select("u", "v")


def _met(pairs: DataFrame, side: DataFrame, at: str, total: int) -> DataFrame:
    """`pairs`, a written table of `total` rows, with what `side` (node and more) has for the node in column `at`.

    A node of very many pairs is broadcast to them, so its pairs stay in as many tasks as before.
    """
    counts = pairs.groupBy(F.col(at).alias("node")).agg(F.count("*").alias("n"))
    return counted_join(pairs, side.join(counts, "node").withColumnRenamed("node", at), [at], total).drop("n")


def _near(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (u, v) whose fingerprints differ in DISTANCE bits or fewer and whose sets can reach 0.8."""
    pairs = cut(pairs.distinct())
    total = pairs.count()
    first = cut(_met(pairs, wide.toDF("node", "w1"), "u", total))
    return _candidates(_met(first, wide.toDF("node", "w2"), "v", total).where(_differ("w1", "w2", WORDS) <= DISTANCE))


def _sets(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The columns of `nodes`, which has row, but row, and the set of the hashes of the text's shingles."""
    keep = [c for c in nodes.columns if c != "row"]

    def run(batches):
        for b in batches:
            sets = [shingle_set(t or b"", shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], [*keep, "set"])

    return cut(texts.select("row", F.col("text").cast("binary").alias("text")).join(nodes, "row").select(*keep, "text").mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", set array<long>"))


def alike(pairs: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) of nodes whose shingles have a Jaccard similarity of 0.8 or more. `rows` has row and node, each once."""
    pairs = cut(pairs.distinct())
    asked = cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(rows, "node"))
    sets, total = _sets(asked, texts, shingle), pairs.count()
    both = _met(cut(_met(pairs, sets.toDF("node", "s1"), "u", total)), sets.toDF("node", "s2"), "v", total)
    shared, most = F.size(F.array_intersect("s1", "s2")), F.size("s1") + F.size("s2")
    return both.where(9 * shared >= 4 * most).select("u", "v")  # shared / (most - shared) >= 4 / 5


def _hubs(members: DataFrame) -> DataFrame:
    """The pairs (u, v) of each member of crowded blocks with ASKED hubs of them at most; members are (node, full, score), full the crowded blocks.

    Copies of one text are nearer to it than to each other, so it stands in blocks with more of them than any copy does: the
    hub of a block is the member whose crowded blocks hold most in all.
    """
    listed = members.where("score is not null").select("node", "score", F.explode("full").alias("key"))
    hubs = listed.groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub"), F.count("*").alias("n"))
    total = members.agg(F.sum(F.size("full"))).first()[0] or 0
    best = counted_join(listed, hubs, ["key"], total).where("node <> hub.node").groupBy("node").agg(F.sort_array(F.collect_set("hub"), asc=False).alias("hubs"))
    return best.select(F.col("node").alias("u"), F.explode(F.slice("hubs", 1, ASKED)["node"]).alias("v"))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], near: Column) -> DataFrame:
    """The pairs u < v, with whatever else both sides have, of different roots that meet on the keys and are `near`; a pair once for each key."""
    both = left.join(right, on).where((F.col("r1") != F.col("r2")) & near)
    return both.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def _rarest(sets: DataFrame) -> DataFrame:
    """token, node, root, size and cap for the rarest fifth of each set's shingles (node, root, set), rarest first but for those of one set only.

    Of two sets at 0.8 neither is larger than the other's cap at the first token that both have: fewer are left there than they must share.
    """
    listed = sets.select(F.explode("set").alias("h")).groupBy(F.col("h").bitwiseAND(SLOTS - 1).alias("slot")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in listed:
        counts[slot] = n

    def run(batches):
        for b in batches:
            values, ends = b.column("set").values.to_numpy(), b.column("set").offsets.to_numpy()
            tokens, caps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, k in zip(ends[:-1], ends[1:]):
                own, n = values[i:k], k - i
                often = counts[own & (SLOTS - 1)]
                first = np.lexsort((own, often))[: n - -(-4 * n // 5) + 1]
                met = np.flatnonzero(often[first] > 1)
                tokens.append(own[first[met]])
                caps.append(9 * (n - met) // 4 - n)
            each = [len(x) for x in tokens[1:]]
            whole = [b.column(c).to_numpy() for c in ("node", "root")] + [np.diff(ends).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(tokens), *(np.repeat(x, each) for x in whole), np.concatenate(caps))], ["token", "node", "root", "size", "cap"])

    return cut(sets.mapInArrow(run, "token long, node long, root long, size long, cap long"))


def _sharing(entries: DataFrame) -> DataFrame:
    """The pairs (u, v) of different roots that have a token of _rarest() in common, neither larger than the other's cap.

    The smaller stands on the left. A token of more than TILE entries is parted by the size of the smaller: the larger is listed for each
    step of sizes that its cap leaves.
    """
    tokens = entries.groupBy("token").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed")).where("mixed").drop("mixed")
    met = cut(counted_join(entries, tokens, ["token"], entries.count()))
    step = lambda size: F.when(F.col("n") > TILE, F.floor(F.log(size) * STEPS)).otherwise(F.lit(-1)).cast("int")
    smaller = met.where("size <= cap").withColumns({"step": step(F.col("size")), "left": F.lit(True)})
    larger = met.withColumns({"step": F.explode(F.sequence(step(F.expr("(4 * size + 4) div 5")), step(F.least("size", "cap")))), "left": F.lit(False)})
    members = smaller.unionByName(larger).drop("n")
    keys = members.groupBy("token", "step").agg(F.count("*").alias("n"), F.count_if("left").alias("lefts"), F.min(F.when(F.col("left"), F.col("size"))).alias("least"), (F.min("root") != F.max("root")).alias("mixed"))
    keys = cut(keys.where("mixed and lefts > 0").drop("mixed"))
    met = counted_join(members, keys, ["token", "step"], keys.agg(F.sum("n")).first()[0] or 0).where("left or cap >= least")
    tiles = lambda n: F.ceil(F.sqrt(n / TILE))
    of = {"tile": F.col("lefts"), "other": F.col("n") - F.col("lefts")}
    own = {c: F.pmod(F.xxhash64("node"), tiles(n)) for c, n in of.items()}
    every = {c: F.explode(F.sequence(F.lit(0).cast("long"), tiles(n) - 1)) for c, n in of.items()}
    at = ["token", "step", "tile", "other"]
    left = met.where("left").withColumn("tile", own["tile"]).withColumn("other", every["other"]).select(*at, F.col("node").alias("u"), F.col("root").alias("r1"), F.col("size").alias("n1"), F.col("cap").alias("c1"))
    right = met.where("not left").withColumn("other", own["other"]).withColumn("tile", every["tile"]).select(*at, F.col("node").alias("v"), F.col("root").alias("r2"), F.col("size").alias("n2"), F.col("cap").alias("c2"))
    once = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("u") < F.col("v")))
    return _pairs(left, right, at, (F.col("n1") <= F.col("c2")) & (F.col("n2") <= F.col("c1")) & once).select("u", "v").distinct()


def linked(nodes: DataFrame, texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """node and root, the smallest node it is linked to, for every node (node, row, wide, keys of blocks of `bits`) with a link; `texts` has row and text."""
    wide, rows = nodes.select("node", "wide"), nodes.select("node", "row")
    own, other = ([f"{side}{i}" for i in range(SKETCH)] for side in "st")
    sketch = [F.col("wide")[i].alias(c) for i, c in enumerate(own)]
    apart = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(own, other)), F.lit(0))
    listed = nodes.select(F.explode("keys").alias("key"), "node", *sketch)
    low = listed.groupBy("key").agg(F.min(F.struct("node", *own)).alias("low"), F.count("*").alias("n")).select("key", "n", F.col("low.node").alias("v"), *(F.col(f"low.{a}").alias(b) for a, b in zip(own, other)))
    low, total = cut(low), nodes.count() * len(tables(bits))
    met = counted_join(listed, low, ["key"], total).withColumn("d", apart)
    near = F.when((F.col("d") <= SKETCH_DISTANCE) & (F.col("v") != F.col("node")), F.struct("d", "v"))
    full = F.col("n") > CROWDED
    asked = met.groupBy("node").agg(F.sort_array(F.collect_set(near)).alias("near"), F.collect_list(F.when(full, F.col("key"))).alias("full"), F.sum(F.when(full, F.col("n"))).alias("score"))  # at most one of each for each block
    asked = cut(asked.where((F.size("near") > 0) | F.col("score").isNotNull()))
    first = asked.select(F.col("node").alias("u"), F.explode(F.slice("near", 1, ASKED)["v"]).alias("v"))
    edges = cut(alike(_near(first.unionByName(_hubs(asked)), wide), rows, texts, shingle))
    stars = graph.linked(edges)
    roots = nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = roots.select(F.explode("keys").alias("key"), "node", "root", *sketch)
    crowded = blocks.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed"), F.count("*").alias("n")).where(F.col("n") > CROWDED)
    crowded = cut(crowded)
    inside = counted_join(blocks.select("key", "node", "root"), crowded.where(F.col("mixed") & (F.col("n") > DENSE)).select("key", "n"), ["key"], total)
    inside = cut(inside.select("node", "root").distinct())
    close = _near(_sharing(_rarest(_sets(inside.join(rows, "node"), texts, shingle))), wide)
    # from here on members of dense blocks, who have met, are of one root
    apart_from = cut(stars.join(inside.select("node", F.lit(TOGETHER).alias("met")), "node", "full").select("node", F.coalesce("met", "root").alias("root")))
    roots = nodes.join(apart_from, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = roots.select(F.explode("keys").alias("key"), "node", "root", *sketch)
    # keys of very many members are few and broadcast; the shuffle that leaves out the other crowded ones is the one that the pairs need
    limit = max(total // BROADCAST_ROWS, COOL_ROWS)
    few = blocks.join(F.broadcast(crowded.where(F.col("n") > limit)), "key", "left_anti").join(crowded.where(F.col("n") <= limit), "key", "left_anti")
    few = _pairs(few.toDF("key", "u", "r1", *own), few.toDF("key", "v", "r2", *other), ["key"], (F.col("u") < F.col("v")) & (apart <= SKETCH_DISTANCE)).select("u", "v").distinct()
    mixed = crowded.where(F.col("mixed") & (F.col("n") <= DENSE)).select("key", "n")
    many = counted_join(roots.select(F.explode("keys").alias("key"), "node", "root", "wide"), mixed, ["key"], total).drop("n")
    test = (F.col("u") < F.col("v")) & (_differ("w1", "w2", SKETCH) <= SKETCH_DISTANCE) & (_differ("w1", "w2", WORDS) <= DISTANCE)
    many = _candidates(_pairs(many.toDF("key", "u", "r1", "w1"), many.toDF("key", "v", "r2", "w2"), ["key"], test))
    return graph.linked(stars.toDF("u", "v").unionByName(alike(_near(few, wide).unionByName(many).unionByName(close), rows, texts, shingle)))


def rooted(texts: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, node and root, the smallest node of its group, for every row of a written table (row, doc_id, text)."""
    bits = block_bits(texts.count())
    rows = cut(fingerprints(texts, bits, shingle))
    nodes = cut(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("wide").alias("wide"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    found = linked(nodes.drop("n"), texts, shingle, bits).join(nodes.select("node", "n"), "node")
    return counted_join(rows.drop("wide", "keys"), found, ["node"], rows.count(), how="left").drop("n").withColumn("root", F.coalesce("root", "node"))


def near_dedup(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row per input row: doc_id, node and component_id, the smallest doc_id reachable."""
    rows = cut(rooted(cut(pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())), shingle))
    lowest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lowest, "root").select("doc_id", "node", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component, as simhash.one_of_each says."""
    return one_of_each(docs, lambda texts: rooted(texts, shingle))
