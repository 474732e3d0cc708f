"""The operators against brute force on small tables with the awkward cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from kindling.llm import bpe, exact_dedup, line_dedup, mixing, quality_model, quality_rules, simhash, token_files, toxicity, warc, wide_simhash
from kindling.llm.queries import vocabulary

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
LINE = "This passage of more than forty characters stands in many documents"
TEXTS = [None, "", "a b", "A  b\tc\nd", "same text", "same text", "same text", LONG, LONG + " x", "é" * 50, f"{LINE}\nown one", f"x\n {LINE.upper()} ", f"{LINE}\n{LINE}", LINE, f"{LINE}\r", "<|endoftext|> you idiot\n\n  end "]
DOCS = [(i, t, f"src{i % 3}" if i % 5 else None, "shadow", 1) for i, t in enumerate(TEXTS)] + [(None, "same text", "src1", "s", 2), (4, "same text", "src1", "s", 2), (4, "other", "src1", "s", 3)]
SCHEMA = "doc_id long, text string, source string, fp string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")


def ids_of(text):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")


def test_rice_round_trip():
    for gaps in (np.array([0]), np.array([5, 0, 1 << 40, 7]), np.random.default_rng(1).integers(0, 1 << 30, 500)):
        k, unary, rest = exact_dedup.rice_encode(gaps)
        assert np.array_equal(exact_dedup.rice_decode(len(gaps), k, unary, rest), gaps)


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(DOCS)
    for text in {t or "" for _, t, *_ in DOCS}:
        sha, ids = hashlib.sha256(text.encode()).hexdigest(), [d for d, t, *_ in DOCS if (t or "") == text]
        rows = [r for r in got if r.text_sha256 == sha]
        assert len(rows) == len(ids) and {r.group_size for r in rows} == {len(ids)} and {r.keep_id for r in rows} == {max(d for d in ids if d is not None)}
        assert [r.doc_id for r in rows if r.kept] == [rows[0].keep_id]
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t, *_ in DOCS})
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_simhash(text, k):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.near_dedup(docs, 3).collect()
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got) == sorted((d or -1, brute_simhash(t, 3)) for d, t, *_ in DOCS)
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7} and {r.component_id for r in got if r.doc_id in (0, 1)} == {0}
    assert simhash.near_dedup(empty).count() == 0 and simhash.drop_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("most", [1, 256])
def test_links_in_crowded_blocks(spark, most):
    draw = np.random.default_rng(2)
    base = [int(x) for x in draw.integers(-(1 << 62), 1 << 62, 40)]
    prints = sorted({*base, *(b ^ (1 << int(i)) for b in base for i in draw.integers(0, 62, 3)), *(b ^ 5 for b in base)})
    found = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), most).collect()}
    assert found == {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


@pytest.mark.parametrize("rows", [10**4, 10**6, 10**7, 10**8, 10**9])
def test_blocks_keep_recall_at_every_size(rows):
    bits = wide_simhash.block_bits(rows)
    assert bits >= 16 and rows / 2**bits <= 16
    equal = np.random.default_rng(5).random((4000, wide_simhash.WIDTH)) >= 0.1515
    assert np.mean([e[wide_simhash.tables(bits)].all(axis=1).any() for e in equal]) >= 0.985


@pytest.mark.parametrize("most", [1, 24])
def test_wide_simhash(spark, empty, most, monkeypatch):
    monkeypatch.setattr(wide_simhash, "CROWDED", most)
    words = [f"w{x}" for x in np.random.default_rng(3).integers(0, 10**6, 900)]
    near = [[*words[:i], "new", *words[i:]] for i in (100, 300, 500)]
    rows = [(i, " ".join(w)) for i, w in enumerate([words, *near, words[::-1], ["short"], []])] + [(7, None)]
    got = {r.doc_id: r.component_id for r in wide_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6}
    assert wide_simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("module", [simhash, wide_simhash])
def test_one_row_of_each_group_stays(spark, module):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(300)) for x in "abcd")
    rows = [(None, a, 0), (5, a, 1), (None, b, 2), (None, c, 3), (None, c, 4), (7, d, 5), (7, b + " end", 6), (8, d, 7), (5, c + " and more", 8), (9, None, 9), (None, "", 10), (7, d, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = module.drop_near_copies(docs)
    alike = {0: "a", 1: "a", 2: "b", 6: "b", 3: "c", 4: "c", 8: "c", 5: "d", 7: "d", 11: "d", 9: "", 10: ""}
    named = module.near_dedup(docs)
    assert got.columns == docs.columns and named.count() == len(rows)
    stays = sorted(r.row for r in got.collect())
    assert sorted(alike[r] for r in stays) == ["", "a", "b", "c", "d"] and set(stays) - {5, 11} == {1, 6, 8, 9}
    assert module.drop_near_copies(docs.limit(0)).count() == 0


def test_bpe(docs, empty):
    rows = bpe.encode(docs, vocabulary(), offsets=True).collect()
    assert sorted(map(str, (r.ids for r in rows))) == sorted(str(ids_of(t)) for _, t, *_ in DOCS)
    by = {d: t for d, t, *_ in DOCS if d != 4 and d is not None}
    own = bpe.codec(vocabulary())
    for r in rows:
        if r.doc_id in by and r.doc_id in (9, 15):
            raw = by[r.doc_id].encode()
            assert [raw[a : a + len(own.bytes[i])] for a, i in zip(r.byte_starts, r.ids)] == [own.bytes[i] for i in r.ids]
            assert all(len(raw[:a].decode("utf-8", "ignore")) in (c, c + 1) for a, c in zip(r.byte_starts, r.char_starts))
    out = {(r.n_tokens, r.decoded_sha256) for r in bpe.digests(docs, vocabulary()).collect()}
    assert out == {(len(ids_of(t)), hashlib.sha256((t or "").encode()).hexdigest()) for _, t, *_ in DOCS}
    assert bpe.digests(empty, vocabulary()).count() == 0


@pytest.mark.parametrize("bits", [5, 8, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype("<u4")
    assert np.array_equal(token_files.unpack(token_files.pack(ids, bits), 1000, bits), ids)


def test_token_files(spark, empty):
    rows = spark.createDataFrame([(9 - i, t) for i, t in enumerate([None, "", "a b", LONG, "é中😀"])], "doc_id long, text string")
    got, at = {r.doc_id: r for r in token_files.round_trip(rows, vocabulary()).collect()}, 0
    for d, t in sorted((r.doc_id, r.text) for r in rows.collect()):
        ids = [*ids_of(t), 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(empty, vocabulary()).count() == 0


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.line_dedup(docs).collect()}
    assert got[(10, 2)].kept_text == "own one" and got[(11, 2)].kept_text == "x" and got[(12, 2)].n_dropped == 2 and got[(13, 1)].kept_text == "" and got[(14, 1)].n_dropped == 0
    assert got[(0, 1)].kept_text == "" and got[(0, 1)].n_dropped == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_quality_rules(docs, empty, labels):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect() if r.doc_id not in (4, None)}
    assert got[0].n_words == 0 and got[0].base_failed and got[7].n_words == 20_000 and got[7].base_failed and got[12].n_dup_lines == 1 and got[15].n_symbols == 4
    assert quality_rules.quality_rules(empty, labels).count() == 0 and quality_rules.drop_poor(docs, labels.limit(0)).columns == docs.columns


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, size(t)) for d, t, *_ in DOCS)
    taken = sum(r.taken for r in got)
    assert abs(taken - sum(r.size for r in got)) <= 8 and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0 and sum(size(r.text) for r in mixing.mixed(docs).collect()) == taken


def test_warc(spark):
    pages = [(1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u v", "é" * 30_000), (None, "u", "<p>one</p>")]
    files = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), warc.shared_dir(spark))
    for split in (50, 4 << 20):
        got = {r.page_id: r for r in warc.read(files, split=split).collect()}
        assert len(got) == 6 and got[2].refers_to == 1 and got[None].refers_to == 1 and got[4].refers_to == 3 and got[1].record_type == "response"
        assert bytes(got[5].payload).decode() == "é" * 30_000 and got[5].payload_bytes == 60_000
        assert got[2].payload_digest == base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()).decode()


def test_classifiers(spark, docs, empty, labels):
    for f in (toxicity.toxicity, quality_model.quality):
        assert all(0 <= r.score <= 1 for r in f(docs, labels).collect()) and f(empty, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(DOCS)
    n = 240
    rows = spark.createDataFrame([(i, f"text {i} " + ("you idiot" if i % 4 == 0 else "all well") + " ***" * (i % 3 == 0)) for i in range(n)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    for f, label in ((toxicity.toxicity, "toxic"), (quality_model.quality, "quality")):
        held = f(rows, marks).where("held_out").join(marks, "doc_id").collect()
        assert sum(r.predicted == r[label] for r in held) >= 0.9 * len(held)
