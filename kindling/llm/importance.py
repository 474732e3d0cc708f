"""Importance resampling towards a target text: hashed n-grams, weights by log ratio, a Gumbel top-k draw.

Each text becomes a row of a sparse matrix, document by bucket, that is written as blocks of
compressed sparse rows (CSR): ids, row starts, buckets and counts of up to BLOCK_FEATURES
features. The matrix is counted once. Its column sums give the corpus distribution, those of
the target texts give the other one, and the product of the matrix with the vector of gains
gives each document's weight. Only vectors of one number per bucket pass through the driver.

The draw is exact at any size: scores are integers of a range that the formula bounds, so
their histogram finds the score at which the draw ends; only rows from there on are ranked,
over range partitions, and all other rows stay where they are.

Edge cases: a null or empty text has no feature, weight 0, and is never drawn. Words are
counted over the whole of a very long text; it is one row of the matrix, in a block of its
own if need be. Rows that repeat are rows of the matrix each; equal scores go to the smaller
doc_id, equal ids to either row, null ids last. A null doc_id is hashed as `-`. An empty
table gives an empty result; an empty target is a distribution of zero counts. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import cut, pick
from kindling.operators.ranks import ranked

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Features after which a block of the matrix ends, and words whose buckets a task remembers.
BLOCK_FEATURES, MEMO = 1 << 20, 1 << 19
MATRIX = "ids array<long>, starts array<int>, words array<int>, buckets binary, counts binary"
#: Letters a-z, digits and all bytes of non-ASCII characters are kept, A-Z lower-cased, the rest are gaps.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO).split()


class Hashed:
    """Buckets of the runs of 1 to `longest` words; what single words gave is remembered, up to MEMO of them."""

    def __init__(self, buckets: int, longest: int):
        self.n, self.longest, self.known = buckets, longest, {}

    def _of(self, word: bytes) -> int:
        if len(self.known) >= MEMO:
            self.known.clear()
        at = self.known[word] = zlib.crc32(word) % self.n
        return at

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        one = [known[w] if w in known else self._of(w) for w in words]
        for k in range(2, self.longest + 1):
            one += [zlib.crc32(b" ".join(words[i : i + k])) % self.n for i in range(len(words) - k + 1)]
        return np.array(one, np.int64)


def _block(ids: list, sizes: list[int], held: list[np.ndarray], n: int) -> tuple:
    rows = np.repeat(np.arange(len(ids)), [len(h) for h in held])
    keys, counts = np.unique(rows * n + np.concatenate(held), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(ids) + 1) * n)
    return ids, starts.tolist(), sizes, (keys % n).astype("<u4").tobytes(), counts.astype("<u4").tobytes()


def matrix(docs: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The counts of each row's features as CSR blocks, written as a table in the shared folder."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["ids", "starts", "words", "buckets", "counts"]

    def run(batches):
        hashed, ids, sizes, held, n = Hashed(buckets, longest), [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_block(ids, sizes, held, buckets), kinds)], names)

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                ids.append(name)
                sizes.append(len(words))
                held.append(hashed(words))
                n += len(held[-1])
                if n >= BLOCK_FEATURES or len(ids) >= 4096:
                    yield block()
                    ids, sizes, held, n = [], [], [], 0
        if ids:
            yield block()

    rows = pick(docs, id_col, "text").toDF("id", "text").select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, MATRIX))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: a vector of `buckets` numbers, summed in the tasks first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, counts in zip(b.column("buckets"), b.column("counts")):
                at, counts = np.frombuffer(at.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<u4")
                total += np.bincount(at, counts, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = blocks.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.toLocalIterator():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * the log ratio) of each bucket, with one added to each count."""
    s, t, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain, of each row of the matrix."""

    def run(batches):
        for b in batches:
            for ids, starts, words, at, counts in zip(*(b.column(c) for c in ("ids", "starts", "words", "buckets", "counts"))):
                starts = starts.values.to_numpy(zero_copy_only=False)
                at, counts = np.frombuffer(at.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                n, total = (np.diff(np.concatenate(([0], np.cumsum(x)))[starts]) for x in (counts, gain[at] * counts))
                yield pa.RecordBatch.from_arrays([ids.values, words.values.cast(pa.int64()), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score and rank, null where it isn't drawn.

    Of the N rows with at least `least_words` words the floor(percent * N / 100) highest scores are drawn.
    """
    blocks = matrix(docs, "doc_id", buckets, longest)
    gain = gains(column_sums(blocks, buckets), column_sums(matrix(target, target_id, buckets, longest), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = cut(weighted(blocks, gain).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    levels = cut(rows.where(fit).groupBy("score").agg(F.count("*").alias("n")))
    n = levels.agg(F.sum("n")).first()[0] or 0
    drawn = percent * n // 100
    upto = last_score(levels, drawn)
    high = rows.where(fit & (F.col("score") >= upto)) if upto is not None else rows.where("false")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    high = ranked(high, [], order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    low = rows.where(~fit | (F.col("score") < upto)) if upto is not None else rows
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return high.select(names).unionByName(low.withColumn("rank", F.lit(None).cast("long")).select(names))


def last_score(levels: DataFrame, drawn: int) -> int | None:
    """The score of the last row drawn. `levels` has a row per score, of which a range of some 10**5 integers holds all."""
    if not drawn:
        return None
    left = drawn
    for r in levels.orderBy(F.col("score").desc()).toLocalIterator():
        left -= r.n
        if left <= 0:
            return r.score
    raise AssertionError("fewer rows than are drawn")
