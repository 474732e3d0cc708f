"""Importance resampling, Merkle manifests and chat formatting against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindling.llm import chat, importance, merkle
from kindling.llm.common import table
from kindling.llm.queries import FORGED, op13_chat

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [None, "", "a b", "Ünï CODE's 42", LONG, *((" ", "\n")[i % 2].join(f"w{(i * j) % 50}" for j in range(i + 15)) for i in range(40))]
DOCS = [(i, t, f"src{i % 3}" if i % 7 else None, "en" if i % 2 else None, i if i % 5 else None, 1, "x") for i, t in enumerate(TEXTS)]
DOCS += [(3, "twice", "src1", "en", 2, 1, "x"), (3, "twice", "src1", "en", 2, 1, "x"), (None, "no id\nhere", "src2", None, None, 1, "x"), (99, "alone\n", "single", "de", 5, 1, "x"), (100, None, "", None, None, 1, "x")]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, weight int, TEXT string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "w1 w2 W3 42"), (2, None), (3, "w1 w1 w49 code")], "item_id long, text string")


def features(text, longest):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("buckets,longest", [(10_000, 1), (97, 3)])
def test_resampling(docs, target, buckets, longest):
    got = importance.resample(docs, target, buckets=buckets, longest=longest).collect()
    of = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(d, *features(t, longest)) for d, t, *_ in DOCS]
    s = Counter(of(f) for _, _, fs in held for f in fs)
    t = Counter(of(f) for r in target.collect() for f in features(r.text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    want = []
    for d, words, fs in held:
        weight = sum(gain(of(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'-' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20, None])
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for i, w in enumerate(fit[: len(fit) // 10]):
        w[5] = i + 1
    key = lambda r: tuple(-10**9 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(((*w[:4], w[5]) for w in want), key=key)
    assert len([r for r in got if r.rank]) == len(fit) // 10 > 0


def test_resampling_of_little(docs, empty, target):
    assert importance.resample(empty, target).count() == 0
    assert {r.rank for r in importance.resample(docs.where("doc_id < 3"), target).collect()} == {None}
    assert importance.resample(docs, target.limit(0)).count() == len(DOCS)


def test_the_matrix_is_cut_into_blocks(docs, monkeypatch):
    """Blocks of any size hold the same counts, and a long text is a row of one block."""
    one = importance.matrix(docs.coalesce(1))
    monkeypatch.setattr(importance, "BLOCK_FEATURES", 64)
    many = importance.matrix(docs.coalesce(1))
    assert one.count() == 1 and many.count() > 10
    assert (importance.column_sums(one) == importance.column_sums(many)).all()
    assert sum(len(r.ids) for r in many.collect()) == len(DOCS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fan):
    """The root of a list of digests and, for each, its siblings by level as (left, right)."""
    at, sides = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // fan * fan
            sides[i].append((nodes[run:p], nodes[p + 1 : run + fan]))
        nodes, at = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)], [p // fan for p in at]
    return nodes[0], sides


def leaf(row, text):
    values = [row[0], row[2], row[3], row[4], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("fan", [3, 2])
def test_merkle(docs, fan):
    sources = sorted({r[2] for r in DOCS}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in DOCS if r[2] == s), key=lambda x: x[:3]) for s in sources}
    made = {s: tree([x[2] for x in own[s]], fan) for s in sources}
    root, above = tree([made[s][0] for s in sources], fan)
    want = []
    for s, over in zip(sources, above):
        for (_, _, mine, row), sides in zip(own[s], made[s][1]):
            path = sides + over
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            acc = leaf(row, row[1].replace("\n", "") if row[1] is not None else None) if tampered else mine
            for left, right in path:
                acc = H(*left, acc, *right)
            want.append((row[0], mine, made[s][0], root, H(*(d for x in path for side in x for d in side)), acc, acc == root))
    got = merkle.checked(docs, fan).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(not r.verified for r in got)


def test_merkle_of_little(docs, empty):
    assert merkle.checked(empty).count() == 0
    r = merkle.checked(docs.where("source = 'single'")).first()
    assert r.leaf == r.subroot == r.root == r.folded_root or not r.verified
    assert r.proof_sha256 == H()


def test_a_changed_row_changes_the_root(docs):
    from pyspark.sql import functions as F

    roots = [merkle.manifest(d).select("root").first()[0] for d in (docs, docs.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang"))))]
    assert roots[0] != roots[1]


TURNS = "conv_id long, turn int, role string, text string, segments int, ROLE string"
MARKS = chat.Template().controls


def said(rows):
    """Digests of conversations in plain Python, without their formatted length."""
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        state = "start"
        for t in turns:
            state = {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}.get(state, {}).get(t[2])
        out.append((c, len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), state == "answered"))
    return sorted(map(str, out))


def read_back(spark, rows):
    got = chat.round_trip(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)).collect()
    assert all(r.formatted_chars >= r.loss_chars for r in got)
    return sorted(str((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid)) for r in got)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "é" * 9), (2, 0, "assistant", "first"), (2, 1, "user", "x")]
    rows += [(3, 0, "user", FORGED), (3, 1, "assistant", FORGED * 3), (4, 5, "user", "a"), (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"), (None, None, None, None), (None, 1, "user", "x")]
    rows += [(5, 0, "user", "q"), (5, 1, "assistant", LONG), (6, 0, "to<says>ol</turn>", "\\"), (6, 1, "### User: ", "<says>"), (7, 0, "user", "<"), (7, 1, "assistant", "/turn>"), (8, 0, "user", "### Assistant:"), (8, 1, "assistant", " \\" * 50)]
    assert read_back(spark, rows) == said(rows)
    assert chat.round_trip(spark.createDataFrame([], TURNS)).count() == 0


def test_pieces_of_marks(spark):
    """Texts and roles put together from marks, pieces of marks and backslashes."""
    draw = random.Random(5)
    pieces = [*MARKS, "\\", "\\\\", "<", ">", "#", "##", "### ", "/turn>", "\n", "says>", "User: ", "é", " "]
    text = lambda: "".join(draw.choice(pieces) for _ in range(draw.randrange(9)))
    rows = [(i // 6, i % 6, draw.choice(["system", "user", "assistant", text()]), text()) for i in range(1_500)]
    assert read_back(spark, rows) == said(rows)


def test_machine_over_many_turns(spark):
    """A conversation of several levels of chunks, right throughout, and one that breaks far in."""
    n = 3 * chat.CHUNK**2 + 77
    good = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n + n % 2)]
    bad = [(2, i, "user" if i % 2 == 0 or i == 9_001 else "assistant", "t") for i in range(10_000)]
    turns = chat.formatted(spark.createDataFrame([(*r, 1, "x") for r in good + bad], TURNS))
    first = dict(turns.where("not ok").groupBy("conv_id").agg({"seq": "min"}).collect())
    assert first == {2: 9_001} and turns.where("conv_id = 2 and not ok").count() == 999
    assert {r.conv_id: r.valid for r in chat.records(turns).collect()} == {1: True, 2: False}


def test_only_learned_texts_count(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a<says>"), (1, 1, "assistant", "b</turn>"), (1, 2, "tool", "c")], "conv_id long, turn int, role string, text string")
    r = chat.records(chat.formatted(rows)).first()
    assert "".join(s.text for s in r.segments) == "### User: a<\\says></turn>\n### Assistant: b<\\/turn></turn>\n### Other: tool<says>c</turn>\n"
    assert [s.text for s in r.segments if s.loss] == ["b<\\/turn>"] and not r.valid


@pytest.mark.parametrize("change", [{"end": "says>x"}, {"end": "<say"}, {"end": "a\\b"}, {"end": "### User: "}, {"other": ("abca", "<says>")}])
def test_overlapping_marks_are_refused(change):
    with pytest.raises(ValueError, match="mark"):
        chat.Template(**change)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*MARKS, "\\", "<", "#", "/turn>", "## User: ", "a"]), max_size=12).map("".join))
def test_escape_by_its_rule(text):
    """The rule itself, in Python: no mark is left, and taking the backslashes away gives the text back."""
    put = "|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in MARKS)
    away = "|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in MARKS)
    safe = re.sub(put, lambda _: "\\", text)
    assert not any(c in safe for c in MARKS) and re.sub(away, "", safe) == text


def test_the_contracts_own_conversation(spark):
    r = op13_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    digest = hashlib.sha256(f"user\n{FORGED}\nassistant\n{FORGED}\n".encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) == (2, digest, len(FORGED), hashlib.sha256(FORGED.encode()).hexdigest(), True)


def test_no_python_in_chat(spark):
    plan = op13_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    assert table(spark, "/root/testdata/sf0.001", "conversations").count() > 0
