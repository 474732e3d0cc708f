"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each partition sorts the 48-bit fingerprints (the head of a text's SHA-256) of its rows
and sends every owner of a fingerprint range its slice, as Rice-coded gaps. Owners answer
with a bitmap of those that another partition sent too. Only rows behind a set bit are
suspects; their texts alone are shuffled and compared byte for byte.

Edge cases: a null text is empty; empty texts form a group like any other. A null doc_id is
smaller than any other; a group of null ids has a null keep_id. Of rows that repeat both
doc_id and text one stays. A very long text is hashed whole, and compared whole only where its fingerprint occurs
elsewhere. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import bounded, counted_join, cut, flat, pick

FINGERPRINT_BITS = 48
#: Rows whose fingerprints one owner holds, about.
OWNER_ROWS = 1_000_000


def rice_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and packed remainders of non-negative gaps."""
    k = max(0, int(gaps.mean()).bit_length() - 1) if len(gaps) else 0
    high, low = gaps >> k, gaps & ((1 << k) - 1)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(gaps) else 0, np.uint8)
    unary[ends] = 1
    bits = (low[:, None] >> np.arange(k)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    return (high.astype(np.int64) << k) + (bits << np.arange(k)).sum(axis=1, dtype=np.int64)


def _decoded(owner: int, width: int, m) -> np.ndarray:
    return owner * width + np.cumsum(rice_decode(m.n, m.k, m.unary, m.rest))


def suspects(prints: DataFrame, owners: int) -> DataFrame:
    """The fingerprints (column fp) that more than one row of `prints` has, each once."""
    width = -(-(1 << FINGERPRINT_BITS) // owners)

    def send(batches):
        held = [b["fp"].to_numpy(np.int64) for b in batches]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        owner = values // width
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        part, rows = TaskContext.get().partitionId(), []
        for a, b in zip(edges, [*edges[1:], len(values)]):
            o = int(owner[a])
            k, unary, rest = rice_encode(np.diff(values[a:b], prepend=o * width))
            rows.append((part, o, int(b - a), k, unary, rest, np.packbits(counts[a:b] > 1).tobytes()))
            if len(rows) == 256:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["part", "owner", "n", "k", "unary", "rest", "twice"]

    def own(key, messages):
        o = int(key[0])
        slices = [_decoded(o, width, m) for m in messages.itertuples()]
        values, counts = np.unique(np.concatenate(slices), return_counts=True)
        shared = values[counts > 1]
        bitmaps = [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in slices]
        return pd.DataFrame({"part": messages["part"], "owner": o, "bitmap": bitmaps})

    def receive(batches):
        for b in batches:
            found = []
            for m in b.itertuples():
                bits = np.frombuffer(m.bitmap, np.uint8) | np.frombuffer(m.twice, np.uint8)
                found.append(_decoded(m.owner, width, m)[np.unpackbits(bits)[: m.n] == 1])
            yield pd.DataFrame({"fp": np.concatenate(found) if found else np.empty(0, np.int64)})

    sent = cut(prints.select("fp").mapInPandas(send, "part int, owner int, n int, k int, unary binary, rest binary, twice binary"))
    answers = sent.drop("twice").groupBy("owner").applyInPandas(own, "part int, owner int, bitmap binary")
    return sent.join(answers, ["part", "owner"]).mapInPandas(receive, "fp long").distinct()


def _hashed(df: DataFrame) -> DataFrame:
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    df = df.withColumn("sha", sha).withColumn("fp", F.conv(F.substring("sha", 1, FINGERPRINT_BITS // 4), 16, 10).cast("long"))
    return df.withColumn("sha", F.unhex("sha"))  # 32 bytes


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept.
    """
    spark, texts = docs.sparkSession, _hashed(pick(docs, "doc_id", "text"))
    light = cut(texts.select("doc_id", "sha", "fp", F.monotonically_increasing_id().alias("row")))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((n := light.count()) / OWNER_ROWS))
    doubtful = cut(suspects(light, owners))
    doubtful = bounded(doubtful, doubtful.count())
    # Byte verification: the text itself is a grouping key, summed before the shuffle.
    same = (
        texts.join(doubtful, "fp", "left_semi")
        .groupBy("fp", "sha", F.coalesce("text", F.lit("")).alias("text"))
        .agg(F.count("*").alias("n"))
        .groupBy("fp", "sha")
        .agg(F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .where(F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("group_size") > 1))
        .drop("texts")
    )
    top = light.join(doubtful, "fp", "left_semi").groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "row")).alias("top"))
    groups = cut(same.join(top, ["fp", "sha"]))
    marked = counted_join(light, groups, ["fp", "sha"], n, "group_size", "left")
    return marked.select(
        "doc_id",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns."""
    marks = cut(exact_dedup(docs))
    frame, at = flat(docs)
    frame = frame.withColumn("sha", F.sha2(F.coalesce(at["text"], F.lit("")), 256)).withColumn("id", at["doc_id"])
    pairs = (
        marks.where("group_size > 1")
        .groupBy(F.col("doc_id").alias("id2"), F.col("text_sha256").alias("sha2"))
        .agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    )
    same = [F.col("id").eqNullSafe(F.col("id2")), F.col("sha") == F.col("sha2")]
    rest = frame.join(pairs.where("not stays"), same, "left_anti")
    again = cut(pairs.where("stays and n > 1"))
    if not again.isEmpty():
        once = rest.join(again, same, "left_semi").dropDuplicates(["id", "sha"])
        rest = rest.join(again, same, "left_anti").unionByName(once)
    return rest.drop("sha", "id").toDF(*docs.columns)
