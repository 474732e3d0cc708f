"""Encoding and decoding share a Python worker and a vocabulary, and neither lists a whole batch."""

import pyarrow as pa

from kindling.llm import bpe
from kindling.llm.queries import vocabulary

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_one_python_worker_a_task(spark):
    docs = spark.read.parquet(DOCS)
    plan = bpe.digests(docs, vocabulary())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = lambda df: sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in df.collect()), key=str)
    got = rows(bpe.round_trip(docs, vocabulary()))
    assert got == rows(bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())) and len(got) == docs.count()
    assert sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()) == sorted((i, d) for i, _, d in got)


def test_groups_take_slices(monkeypatch):
    texts = [None, b"", b"a" * 10, b"\xff", *(f"text {i}".encode() for i in range(1000))]
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1000)
    sizes = []

    class Column:
        def __init__(self, own):
            self.own = own

        def __len__(self):
            return len(self.own)

        def slice(self, at, n):
            sizes.append(n)
            return self.own.slice(at, n)

    got = list(bpe.groups(Column(pa.array(texts, pa.binary()))))
    assert [t for _, held in got for t in held] == [(t or b"").decode("utf-8", "replace") for t in texts]
    assert [first for first, _ in got] == [sum(len(h) for _, h in got[:i]) for i in range(len(got))] and len(got) > 5
    assert max(sizes) <= bpe.LISTED_ROWS and len(sizes) > 1


def test_the_memo_is_halved_in_place(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ROWS", 100)
    own = bpe.Codec(vocabulary())
    memo, texts = own.memo, [" ".join(f"w{i}x{j}" for i in range(30)) for j in range(20)]
    got = [own.encode([t])[0].tolist() for t in texts]
    assert own.memo is memo and len(memo) <= 100
    assert [own.decode(x).decode() for x in got] == texts
    monkeypatch.setattr(bpe, "MEMO_ROWS", 10**6)
    assert [x.tolist() for x in bpe.Codec(vocabulary()).encode(texts)] == got
