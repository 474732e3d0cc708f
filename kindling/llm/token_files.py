"""Token files with ids of fixed width, bit-packed.

An id takes the fewest bits that hold the vocabulary. Ids are packed in blocks of BLOCK; a
footer lists each block's offset, each document's first id and its doc_id, all in columns of
fixed width, so a reader finds any document by a few seeks and unpacks whole blocks in numpy.

    file: packed blocks, block offsets (u64), document starts (u64, one more than documents),
    doc_ids (i64), flags (u8, 1 where doc_id is null), tail (7 x u64: bits, block, blocks,
    ids, documents, offset of the footer, MAGIC)

Files are written in ascending doc_id order, null first; rows of one doc_id stand together
in the order of a hash of their texts, so reruns agree, and may fill any number of files. A null or empty text is the end id alone. A very long text is encoded and written whole, over as many blocks as it takes. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm.bpe import codec, groups
from kindling.llm.common import cut, pick, shared_dir
from kindling.llm.files import created, opened

BLOCK = 4096
MAGIC = 0x31_50_54_4B
END_ID = 2
#: Documents that one reading task takes.
READ_DOCS = 4096


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    bit = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (bit.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, 0
        self.offsets, self.lengths, self.names, self.void = array("q"), array("q"), array("q"), bytearray()
        self.rest, self.held = [np.empty(0, "<u4")], 0

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.rest)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            data = pack(ids[i : min(i + BLOCK, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest, self.held = [ids[whole:]], len(ids) - whole

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        self.names.append(doc_id or 0)
        self.void.append(doc_id is None)
        self.lengths.append(sum(map(len, ids)))
        self.rest += ids
        self.held += self.lengths[-1]
        if self.held >= 64 * BLOCK:
            self._flush()

    def close(self) -> tuple[int, int]:
        self._flush(last=True)
        starts = np.concatenate(([0], np.cumsum(np.array(self.lengths, np.int64))))
        for a in (np.array(self.offsets, "<u8"), starts.astype("<u8"), np.array(self.names, "<i8"), np.frombuffer(self.void, np.uint8)):
            self.out.write(a.tobytes())
        n, ids = len(self.names), int(starts[-1])
        self.out.write(np.array([self.bits, BLOCK, len(self.offsets), ids, n, self.at, MAGIC], "<u8").tobytes())
        return n, ids


class Reader:
    def __init__(self, path: str):
        self.file = opened(path)
        self.file.seek(self.file.size() - 56)
        self.bits, self.block, self.blocks, self.ids, self.docs, self.footer, magic = (int(x) for x in np.frombuffer(self.file.read(56), "<u8"))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")

    def _column(self, at: int, kind: str, first: int, n: int) -> np.ndarray:
        self.file.seek(at + first * np.dtype(kind).itemsize)
        return np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)

    def documents(self, first: int, n: int):
        """doc_id, first id within the file, ids of `n` documents from the one numbered `first`."""
        n = min(n, self.docs - first)
        at = self.footer + 8 * self.blocks
        starts = self._column(at, "<u8", first, n + 1).astype(np.int64)
        names = self._column(at + 8 * (self.docs + 1), "<i8", first, n)
        void = self._column(at + 8 * (self.docs + 1) + 8 * self.docs, "u1", first, n)
        for i in range(n):
            yield (None if void[i] else int(names[i])), int(starts[i]), self.range(int(starts[i]), int(starts[i + 1]))

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file, from the blocks that hold them."""
        if a == b:
            return np.empty(0, "<u4")
        k, end = a // self.block, -(-b // self.block)
        first = getattr(self, "cached", None)
        if first is None or not (first[0] <= k and end <= first[1]):
            wide = min(self.blocks, max(end, k + 64))
            offsets = self._column(self.footer, "<u8", k, wide - k)
            stop = self.footer if wide == self.blocks else int(self._column(self.footer, "<u8", wide, 1)[0])
            self.file.seek(int(offsets[0]))
            n = min(self.ids, wide * self.block) - k * self.block
            self.cached = (k, wide, unpack(self.file.read(stop - int(offsets[0])), n, self.bits))
        k = self.cached[0] * self.block
        return self.cached[2][a - k : b - k]


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encodes all texts into files of ascending doc_id; part, path, n_docs, n_tokens and start of each file."""

    def run(batches):
        own, part = codec(vocabulary), TaskContext.get().partitionId()
        bits, last = (own.size - 1).bit_length(), np.array([end_id], own.kind)
        batches = iter(batches)
        one = next((b for b in batches if b.num_rows), None)
        if one is None:
            return
        with created(folder, f"tokens-{part:06d}") as (path, out):
            to = Writer(out, bits)
            while one is not None:
                names = one.column("doc_id").to_pylist()
                for first, held in groups(one.column("text")):
                    for name, ids in zip(names[first:], own.encode(held)):
                        to.add(name, ids, last)
                one = next(batches, None)
            n, ids = to.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n], "n_tokens": [ids]})

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    files = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "part long, path string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                out = [(d, r["start"] + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in Reader(r["path"]).documents(r["first"], READ_DOCS)]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = files.select("path", "start", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(READ_DOCS))).alias("first"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    return read(write(docs, vocabulary, shared_dir(docs.sparkSession)))
