"""Queries and pipeline stages on whole tables against brute force, at the smallest scale."""

import base64
import hashlib
import math
import re
import struct
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
import regex
import xxhash

import corpus_pipeline
from kindling.llm import queries, quality_rules
from kindling.llm.common import cut, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+")


def split(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, SF, "documents").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    names = want.column_names
    got = queries.QUERIES[name](spark, SF).select(names).toArrow()
    assert sorted(map(str, got.to_pylist())) == sorted(map(str, want.to_pylist()))


def grams(text):
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in TOKEN.findall(text or "")]
    pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))
    return [x % quality_rules.BUCKETS for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:]))]]


def crc(doc_id):
    return __import__("zlib").crc32(str(doc_id).encode()) % 4


def verdicts(spark, rows):
    """By doc_id: the measures of the rules, base_failed and score."""
    good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1 and crc(r.doc_id) != 2}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(g := grams(r.text))
        if r.doc_id in good:
            target.update(g)
    n, k = quality_rules.BUCKETS, quality_rules.SMOOTHING
    ratio = [math.log((target[b] + k) / (target.total() + k * n) * (raw.total() + k * n) / (raw[b] + k)) for b in range(n)]
    out = {}
    for r in rows:
        w, g = split(r.text), grams(r.text)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeated = len({p for starts in at.values() if len(starts) > 1 for i in starts for p in range(i, i + 8)})
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        measures = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), repeated)
        out[r.doc_id] = (measures, failed, sum(ratio[b] for b in g) / max(1, len(g)))
    return out


def test_quality_rules(spark, rows):
    want = verdicts(spark, rows)
    got = queries.op7_quality_rules(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        measures, failed, score = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures and r.base_failed == failed
        assert abs(r.score - score) < 1e-9 and r.kept == (not failed and score >= quality_rules.THRESHOLD)


def test_quality_rules_on_repeated_words(spark):
    texts = ["a b c d e f g h " * 2, "a " * 40, "x " * 7, " ".join(f"w{i % 31}" for i in range(300)), " ".join(f"w{i}" for i in range(3000)) + " w5 w6 w7 w8 w9 w10 w11 w12", "p q " * 9 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_rules(docs, table(spark, SF, "labels")).collect()}
    for i, text in enumerate(texts):
        w, seen = split(text), defaultdict(list)
        for a in range(len(w) - 7):
            seen[tuple(w[a : a + 8])].append(a)
        assert got[i] == len({p for s in seen.values() if len(s) > 1 for a in s for p in range(a, a + 8)}), i


def roots(nodes, pairs):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash_components(spark):
    got = queries.op4_simhash(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(want)


def targets(sizes):
    """Source -> words it should give: shares by weight, at most three times its own."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), [s for s in names if sizes[s]]
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s]]
        if not full:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in full}
        left, free = left - sum(out[s] for s in full), [s for s in free if s not in full]
    return out


def test_mixing(spark, rows):
    source, size = {r.doc_id: r.source for r in rows}, {r.doc_id: len(split(r.text)) for r in rows}
    sizes, taken = Counter(), Counter()
    for d, s in source.items():
        sizes[s] += size[d]
    want = targets(sizes)
    for r in queries.op9_mixing(spark, SF).collect():
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        assert math.isclose(r.target, want.get(source[r.doc_id], 0.0), rel_tol=1e-9, abs_tol=1e-6)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_pipeline_stages(spark, rows):
    """Each stage on what the one before kept; the decisions of each against brute force."""
    docs, kept = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.collect())
    ruled, exact, near, mixed = kept
    want = {d for d, (_, failed, score) in verdicts(spark, rows).items() if not failed and score >= quality_rules.THRESHOLD}
    assert {r.doc_id for r in ruled} == want and len(ruled) == len(want)
    best = {}
    for r in ruled:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    sets = {r.doc_id: shingles(r.text) for r in exact}
    like = {(a, b): x for a, b in combinations(sorted(sets), 2) if (x := likeness(sets[a], sets[b])) >= 0.5}
    stays = {r.doc_id for r in near}
    alike = roots(sets, [p for p, x in like.items() if x >= 0.9])
    assert max(Counter(alike[d] for d in stays).values()) == 1  # one of each group of close copies
    loose = roots(sets, like)
    assert {loose[d] for d in stays} == set(loose.values())  # no group is lost
    assert all(any(d in p for p in like) for d in sets.keys() - stays)  # a document without a near copy stays
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in near:
        sizes[r.source] += len(split(r.text))
    source = {r.doc_id: r.source for r in near}
    for r in mixed:
        assert r.source == source[r.doc_id]
        taken[r.source] += len(split(r.text))
        times[r.doc_id] += 1
    goal = targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal) and max(times.values()) <= 4
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = [(r.doc_id, len(i := own.encode_ordinary(r.text or "")), sha(" ".join(map(str, i))), sha(r.text or "")) for r in mixed]
    assert sorted(told) == sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens)


def test_pipeline_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").where("doc_id < 0").drop("n_chars").selectExpr("*", "1 AS keep_id", "2 AS node", "cast(null AS long) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() == 0
