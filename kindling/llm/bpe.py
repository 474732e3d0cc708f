"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut after each run of non-blanks; the pattern that splits text before the merges
always ends a match there, so a piece has the same ids wherever it stands. Pieces are looked
up in a memo and the library encodes those not seen yet, a batch at a time; the offsets of its encoding
tell where a piece ends and are held against the byte table. That holds for the byte-level splitting that CUTTABLE
describes. With any other vocabulary, and where a text has blanks other than space and line feed, texts are encoded whole. Decoding maps ids to bytes by the reversed
byte table and joins the bytes before any character is formed, so characters split over
several ids come back whole.

Edge cases: a null or empty text has no ids. Strings of special tokens are ordinary text. Bytes
that aren't UTF-8 are replaced before encoding. Very long texts are encoded whole, by pieces. Repeated rows get equal results; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import pick

#: A piece: blanks, then what isn't blank.
PIECE = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
#: Blanks beside which pieces can't be told apart.
ODD_BLANK = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
# The settings of a vocabulary file under which a match always ends after a run of non-blanks.
CUTTABLE = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}}
#: Entries of the memo; beyond, the later half goes: frequent pieces come early.
MEMO_ROWS, MEMO_BYTES = 800_000, 48
#: New pieces that the library encodes as one text.
JOINED = 500
#: Rows that are decoded at once.
DECODED_ROWS = 200
#: Texts are taken together up to so many characters, and out of their batch so many rows at a time.
GROUP_CHARS, LISTED_ROWS = 1 << 18, 200


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.memo: dict[bytes, bytes] = {}
        letters = byte_letters()
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.bytes = [b""] * self.size
        for piece, i in vocab.items():
            self.bytes[i] = bytes(map(letters.__getitem__, piece)) if all(c in letters for c in piece) else piece.encode()
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, self.size)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        found = lambda want, got: all(found(v, got[k]) if isinstance(v, dict) else got.get(k) == v for k, v in want.items()) if isinstance(got, dict) else False
        self.cuttable = found(CUTTABLE, told)

    def _checked(self, encoding, text: str) -> np.ndarray:
        """The ids of an encoding. Its offsets, in characters, must be those that the byte table gives."""
        ids = np.array(encoding.ids, self.kind)
        if self.cuttable and len(ids):
            starts = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(ids))
            if not np.array_equal(starts, self.offsets(text, ids)[1]):
                raise ValueError("the vocabulary's bytes and the library's offsets differ")
        return ids

    def _new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces, from the library: those with blanks in front and none behind joined, the others each alone."""
        joins = lambda p: self.cuttable and p[0] in b" \n" and p[-1] not in b" \n"
        plain, alone = [p for p in pieces if joins(p)], [p for p in pieces if not joins(p)]
        joined = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        texts = [b"".join(x).decode() for x in joined] + [p.decode() for p in alone]
        ids = [self._checked(e, t) for e, t in zip(self.model.encode_batch(texts, add_special_tokens=False), texts)] if texts else []
        out = {p: x.tobytes() for p, x in zip(alone, ids[len(joined) :])}
        for own, x in zip(joined, ids):
            ends, wanted = np.cumsum(self.lengths[x]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            at = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[at], wanted):
                raise ValueError("an id reaches over the end of a piece")
            raw, at, first = x.tobytes(), ((at + 1) * x.itemsize).tolist(), 0
            for p, end in zip(own, at):
                out[p] = raw[first:end]
                first = end
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        found, new = [], {}
        for t in texts:
            pieces = ([t.encode()] if t else []) if ODD_BLANK.search(t) or not self.cuttable else PIECE.findall(t.encode())
            ids = list(map(self.memo.get, pieces))
            gaps = [i for i, x in enumerate(ids) if x is None]
            pieces = [pieces[i] for i in gaps]
            new.update(dict.fromkeys(pieces))
            found.append((ids, gaps, pieces))
        new = self._new(list(new))
        for ids, gaps, pieces in found:
            for i, p in zip(gaps, pieces):
                ids[i] = new[p]
        self.memo.update((p, x) for p, x in new.items() if len(p) <= MEMO_BYTES)
        if len(self.memo) > MEMO_ROWS:
            for p in list(islice(self.memo, MEMO_ROWS // 2, None)):  # in place: a second memo would stand beside the first
                del self.memo[p]
        return [np.frombuffer(b"".join(ids), self.kind) for ids, _, _ in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and character at which each id starts; within a split character, that character."""
        lengths = self.lengths[ids]
        starts = np.cumsum(lengths) - lengths
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return starts, np.cumsum(lead)[starts] - 1 if len(ids) else starts


@cache
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def groups(texts: pa.Array):
    """Slices (first, texts) of a batch's column, of about GROUP_CHARS each; the batch is never listed whole."""
    held, size, first = [], 0, 0
    for i, t in enumerate(t for k in range(0, len(texts), LISTED_ROWS) for t in texts.slice(k, LISTED_ROWS).to_pylist()):
        held.append((t or b"").decode("utf-8", "replace"))
        size += len(held[-1])
        if size >= GROUP_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype("<i4"), pa.int32()))


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def encode(docs: DataFrame, vocabulary: str, offsets: bool = False) -> DataFrame:
    """doc_id and its ids; with `offsets` also byte_starts and char_starts of each id."""

    def run(batches):
        own = codec(vocabulary)
        for b in batches:
            ids_of = b.column("doc_id")
            for first, held in groups(b.column("text")):
                found = own.encode(held)
                out = [ids_of.slice(first, len(held)), _lists(found)]
                if offsets:
                    pairs = [own.offsets(t, x) for t, x in zip(held, found)]
                    out += [_lists([p[k] for p in pairs]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "ids", *(["byte_starts", "char_starts"] if offsets else [])]
    return _texts(docs).mapInArrow(run, "doc_id long" + "".join(f", {n} array<int>" for n in names[1:]))


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of encode() with `decoded`, the bytes of their ids."""

    def run(batches):
        own = codec(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, DECODED_ROWS):
                part = b.slice(i, DECODED_ROWS)
                lists = part.column("ids")
                flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
                decoded = [own.decode(flat[a:z].tolist()) for a, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """What decode(encode()) gives, doc_id, ids and decoded, by one Python worker a task with one vocabulary in place of two with one each."""

    def run(batches):
        own = codec(vocabulary)
        for b in batches:
            ids_of = b.column("doc_id")
            for first, held in groups(b.column("text")):
                found = own.encode(held)
                decoded = [own.decode(x.tolist()) for x in found]
                yield pa.RecordBatch.from_arrays([ids_of.slice(first, len(held)), _lists(found), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of texts encoded and decoded again."""
    return round_trip(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
