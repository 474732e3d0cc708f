"""Awkward tables: damaged archives, repeated and null ids, clashing names, whole tables of token files."""

import zlib

import numpy as np
import pytest

from kindling.llm import bpe, line_dedup, mixing, token_files, warc
from kindling.llm.common import table
from kindling.llm.queries import vocabulary

PAGES = "page_id long, url string, html string, TEXT string, payload int"


def archive(spark, n=3):
    pages = spark.createDataFrame([(i, "u", f"<p>{'x' * 500} {i}</p>", "t", 1) for i in range(n)], PAGES).coalesce(1)
    return warc.write(pages, warc.shared_dir(spark)).collect()[0]


@pytest.mark.parametrize("harm", ["cut", "middle"])
def test_a_damaged_record_fails(spark, tmp_path, harm):
    found = archive(spark)
    data = open(found.path.removeprefix("file:"), "rb").read()
    starts = [i for i, _ in warc.members(__import__("io").BytesIO(data), 0, len(data))]
    bad = data[: starts[2] + 200] if harm == "cut" else data[: starts[1] + 150] + b"\xff" * 20 + data[starts[1] + 170 :]
    path = tmp_path / "bad"
    path.write_bytes(bad)
    files = spark.createDataFrame([(str(path), len(bad))], "path string, n_bytes long")
    with pytest.raises(Exception, match="cut short or damaged"):
        warc.read(files).collect()


def test_a_lost_head_is_noticed_by_the_count(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"{i}", "t", 1) for i in range(4)], PAGES)
    read = warc.read
    monkeypatch.setattr(warc, "read", lambda files, payloads=True: read(files, payloads).where("page_id <> 2"))
    with pytest.raises(ValueError, match="4 records were written and 3 read"):
        warc.round_trip(pages)


def test_warc_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "a", "same", "t", 1), (1, "b", "same", "t", 2), (5, "c", "same", "t", 3), (None, "d", "other", "t", 4), (None, "e", "other", "t", 5), (9, None, None, None, None)], PAGES)
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    assert got == [(-1, "response", 0), (-1, "response", 0), (1, "response", 0), (1, "response", 0), (5, "revisit", 1), (9, "response", 0)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_token_files_of_awkward_rows(spark):
    rows = [(None, "no id", 1), (3, "three", 2), (3, "three", 2), (-7, None, 3), (None, "", 4), (2, "word " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = token_files.round_trip(docs, vocabulary()).collect()
    own = bpe.codec(vocabulary())
    want = sorted((d is not None, d or 0, len(own.encode([t or ""])[0]) + 1) for d, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # no gap, no overlap


def test_token_files_of_a_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in token_files.round_trip(docs, vocabulary()).collect()}
    own, at = bpe.codec(vocabulary()).model, 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_lines_of_rows_without_id(spark):
    line = "a line of more than forty characters that many documents hold"
    rows = [(None, line, 0), (None, f"{line}\nown", 1), *((i, f"{line}\nof {i}", 2) for i in range(4))]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, bits int")).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_dropped, r.kept_text) for r in got) == [(-1, 1, ""), (-1, 1, "own"), (0, 1, "of 0"), (1, 1, "of 1"), (2, 1, "of 2"), (3, 0, f"{line}\nof 3")]


def test_mix_keeps_both_of_two_clashing_columns(spark):
    rows = [(i, f"OTHER {i}", " ".join(f"w{j}" for j in range(30 + i)), f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, txt string, source string").withColumnRenamed("txt", "tmp")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = mixing.mixed(docs.withColumnRenamed("tmp", "text")).collect()
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert all(r["TEXT"] == f"OTHER {r.doc_id}" and rows[r.doc_id][2].startswith(r["text"]) for r in got) and len(got) > 0


def test_offsets_of_every_text(spark):
    texts = ["hello  world é中😀x\n\n ok", "", "\t a b", "  ", "a\r\nb 😀😀", "ünï x " * 40, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = bpe.codec(vocabulary())
    assert own.cuttable
    for r in bpe.encode(docs, vocabulary(), offsets=True).collect():
        told = own.model.encode(texts[r.doc_id] or "", add_special_tokens=False)
        assert r.ids == told.ids and r.char_starts == [a for a, _ in told.offsets]


def test_token_files_agree_from_run_to_run(spark):
    """Rows of one doc_id, and very many without any, have the same places however the rows lie, over several files."""
    rows = [(None, f"row {i % 40}") for i in range(400)] + [(7, f"seven {i}") for i in range(50)] + [(8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted(map(str, token_files.round_trip(docs.repartition(n), vocabulary()).collect())) for n in (2, 5)]
    assert runs[0] == runs[1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        files = token_files.write(docs.repartition(5), vocabulary(), warc.shared_dir(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1 and max(f.n_docs for f in files) < 300
