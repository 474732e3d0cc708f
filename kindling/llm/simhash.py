"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are four blocks of 16. Two fingerprints that differ in at most two
bits share at least two whole blocks, so each is listed under its six pairs of blocks and
joined there; the Hamming distance is verified in the join. A pair of blocks that many
distinct fingerprints share is not joined with itself: its members look up the 528
fingerprints that flip one or two bits of the other blocks, which finds the same links in
linear work. Equal fingerprints are one node, so copies never make pairs.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any other.
Null ids don't count for component_id; a component without any id has none. Repeated rows
stay repeated. All shingles of a very long text count, in chunks of bounded memory. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import counted_join, cut, flat, pick
from kindling.operators.graph import linked

SEED = 42
BLOCK_BITS, BLOCKS, DISTANCE = 16, 4, 2
PAIRS = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
#: Distinct fingerprints under one key above which its members look up their neighbours.
JOINED_ROWS = 256
CHUNK = 1 << 16


def fingerprint(text: bytes, size: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles."""
    words = text.lower().split()  # of bytes: only A-Z, and only the six ASCII blanks
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches):
        for b in batches:
            prints = [fingerprint(t or b"", shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _block(fp, i: int):
    return F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1)


def links(prints: DataFrame, most: int = JOINED_ROWS) -> DataFrame:
    """Pairs u < v of distinct fingerprints (column fp, each once) at DISTANCE bits or fewer."""
    fp = F.col("fp")
    keys = [
        F.lit(k << 2 * BLOCK_BITS).bitwiseOR(F.shiftleft(_block(fp, i), BLOCK_BITS)).bitwiseOR(_block(fp, j))
        for k, (i, j) in enumerate(PAIRS)
    ]
    listed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = cut(listed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))
    crowded = not hot.isEmpty()
    cold = listed.join(hot, "key", "left_anti") if crowded else listed
    near = cold.select("key", F.col("fp").alias("u")).join(cold.select("key", F.col("fp").alias("v")), "key")
    near = near.where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)).select("u", "v")
    if crowded:
        masks = []
        for k, kept in enumerate(PAIRS):
            free = [BLOCK_BITS * b + i for b in range(BLOCKS) if b not in kept for i in range(BLOCK_BITS)]
            flips = [sum(1 << i for i in c) for n in range(1, DISTANCE + 1) for c in combinations(free, n)]
            masks += [(k, m - (1 << 64) if m >> 63 else m) for m in flips]
        # 6 x 528 rows, whatever the input
        flips = F.broadcast(prints.sparkSession.createDataFrame(masks, "k int, mask long"))
        asked = listed.join(hot, "key", "left_semi").select("fp", F.shiftright("key", 2 * BLOCK_BITS).cast("int").alias("k"))
        asked = asked.join(flips, "k").select(F.col("fp").alias("u"), fp.bitwiseXOR(F.col("mask")).alias("v")).where("u < v")
        near = near.unionByName(asked.join(prints.select(F.col("fp").alias("v")), "v", "left_semi"))
    return near.distinct()


def near_dedup(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row per input row: doc_id, fp and component_id, the smallest doc_id reachable."""
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    found = linked(links(nodes.select("fp")))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return counted_join(rows, named.join(lowest, "root").select("fp", "n", "component_id"), ["fp"], rows.count()).drop("n")


def one_of_each(docs: DataFrame, rooted) -> DataFrame:
    """One row of each group, that with its smallest doc_id, with all columns.

    Rows are told apart by a number that is written with them, so null and repeated ids do no
    harm: null comes last, and of rows with one id the smallest node and number stays.
    `rooted` makes row, doc_id, node and root of a written table (row, doc_id, text).
    """
    frame, at = flat(docs)
    frame = cut(frame.withColumn("row", F.monotonically_increasing_id()))
    marks = cut(rooted(frame.select("row", at["doc_id"].cast("long").alias("doc_id"), at["text"].alias("text"))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "row"))
    groups = cut(marks.groupBy("root").agg(first["row"].alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = cut(counted_join(marks.select("root", "row"), groups, ["root"], marks.count()).where("row <> first").select("row"))
    return frame.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)


def drop_near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component, as one_of_each says."""

    def rooted(texts: DataFrame) -> DataFrame:
        rows = cut(fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), shingle)).withColumnRenamed("doc_id", "row")
        found = linked(links(cut(rows.select("fp").distinct())))
        marks = rows.join(found, F.col("fp") == F.col("node"), "left").select("row", F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"))
        return marks.join(texts.select("row", "doc_id"), "row")

    return one_of_each(docs, rooted)
