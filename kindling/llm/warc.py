"""WARC archives: a writer, and a splittable reader.

Each record is a gzip member of its own. A reading task scans its byte range for the gzip
magic and tries each place by decoding the member's head; one that opens a WARC record is
read whole, past the range's end if it must, and belongs to the range it starts in.
Records of equal payloads become one response, that with the smallest page_id, and revisits.

A member that opens a WARC record and then turns out cut short or damaged fails the read; one whose
head is beyond recognition is missed by the scan, so round_trip() compares the records read with those written.

Edge cases: a null html is an empty payload. A null page_id comes after all others; if no page of
a group has an id all its records are responses. Pages that repeat the smallest page_id
are responses, each. A very long payload is one record, held by one task. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import counted_join, cut, pick, shared_dir, sieved
from kindling.llm.files import created, opened

GZIP = b"\x1f\x8b\x08"
RECORD = b"WARC/"
LEVEL = 3
#: Bytes of an archive that a reading task takes, and of one read.
SPLIT, CHUNK = 4 << 20, 1 << 16


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit if `refers_to` is given, as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url and not any(ord(c) < 33 for c in url):
        head.append(f"WARC-Target-URI: {url}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes one archive per partition; path, n_bytes and n_records of each."""
    own = pick(pages, "page_id", "url", "html")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = own.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha"))
    light = cut(own.where(F.octet_length("html") >= min_bytes).select("sha", "page_id"))
    first = cut(light.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    # payloads without an equal stay where they are, and so do those of large groups
    told = sieved(own, F.xxhash64("sha"), first, F.xxhash64("sha"))
    met = counted_join(told.where("maybe").drop("maybe"), first, ["sha"], light.count(), how="left").drop("n")
    rows = met.unionByName(told.where("not maybe").drop("maybe").withColumn("first", F.lit(None).cast("long")))
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches):
        part, n, size = TaskContext.get().partitionId(), 0, 0
        batches = iter(batches)
        one = next((b for b in batches if b.num_rows), None)
        if one is None:
            return
        with created(folder, f"pages-{part:06d}") as (path, out):
            while one is not None:
                for page, url, payload, refers in zip(*(c.to_pylist() for c in one.columns)):
                    data = record(page, url, payload, refers)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                one = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size], "n_records": [n]})

    return cut(rows.mapInArrow(run, "path string, n_bytes long, n_records long"))


def opening(data: bytes) -> bytes | None:
    """The first bytes of a gzip member, as many as RECORD has if `data` holds them; None if it is no member."""
    try:
        return zlib.decompressobj(31).decompress(data, len(RECORD))
    except zlib.error:
        return None


def members(file, start: int, end: int):
    """The whole of each gzip member that opens a WARC record and starts in [start, end)."""
    file.seek(start)
    buf, base, pos = b"", start, 0

    def more() -> bool:
        nonlocal buf
        got = file.read(CHUNK)
        buf += got
        return bool(got)

    while base + pos < end:
        at = buf.find(GZIP, pos)
        if at < 0:
            keep = max(pos, len(buf) - len(GZIP) + 1)
            buf, base, pos = buf[keep:], base + keep, 0
            if base >= end or not more():
                return
            continue
        if base + at >= end:
            return
        buf, base, pos = buf[at:], base + at, 0
        while (head := opening(buf)) is not None and len(head) < len(RECORD) and RECORD.startswith(head) and more():
            pass
        if head != RECORD:
            pos = 1
            continue
        d, out, fed = zlib.decompressobj(31), [], 0
        try:
            while not d.eof and (fed < len(buf) or more()):
                out.append(d.decompress(buf[fed:]))
                fed = len(buf)
        except zlib.error as e:
            raise ValueError(f"the record at byte {base} is cut short or damaged") from e
        if not d.eof:
            raise ValueError(f"the record at byte {base} is cut short or damaged")
        yield base, b"".join(out)
        used = len(buf) - len(d.unused_data)
        buf, base, pos = buf[used:], base + used, 0


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    web = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    page = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:...>
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {fields['warc-record-id']}: the payload doesn't match its digest")
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": int(web["content-length"]), "payload_digest": digest, "refers_to": page(fields.get("warc-refers-to")), "payload": payload if fields["warc-type"] == "response" else None}


def read(files: DataFrame, payloads: bool = True, split: int = SPLIT) -> DataFrame:
    """Every record of the archives (path, n_bytes), found by byte ranges of `split` bytes."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows, size = [], 0
                with opened(r["path"]) as file:
                    for _, data in members(file, r["first"], r["first"] + split):
                        rows.append(parse(data))
                        size += len(data) if payloads else 0
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in kinds.items()], list(kinds))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in kinds.items()], list(kinds))

    tasks = files.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("first"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return tasks.repartition(n, "path", "first").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = write(pages, shared_dir(pages.sparkSession), min_bytes)
    rows = cut(read(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    written = files.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    if (n := rows.count()) != written:
        raise ValueError(f"{written} records were written and {n} read")
    return rows
