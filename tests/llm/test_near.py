"""The near-copy stage on isolated pairs of known similarity, and on texts that a fingerprint alone gets wrong."""

import numpy as np
import pytest

from kindling.llm import wide_simhash

#: Shingles that both texts of a pair have, of those that each has: Jaccard shared / (2 * own - shared).
SHARED = {0.79: (158, 179), 0.80: (80, 90), 0.82: (82, 91), 0.85: (170, 185)}
PAIRS = 100


@pytest.mark.parametrize("bits", [16, 20, 22])
def test_isolated_pairs(spark, bits, monkeypatch):
    monkeypatch.setattr(wide_simhash, "LEAST_BITS", bits)
    draw, rows = np.random.default_rng(bits), []
    for shared, own in SHARED.values():
        for _ in range(PAIRS):
            a, b = ([f"w{x}" for x in draw.integers(0, 10**9, own + 4)] for _ in "ab")
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(a[: shared + 4] + b[shared + 4 :]))]
    got = {r.doc_id for r in wide_simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= got
    stay = np.array([i in got for i, _ in rows[1::2]]).reshape(len(SHARED), PAIRS).mean(axis=1)
    assert stay[0] == 1  # 0.79 is no near copy
    assert (1 - stay[1:] >= [0.96, 0.98, 0.99]).all(), stay


def test_equal_fingerprints_are_not_enough(spark):
    texts = ["again " * 400 + " ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0] + " end"])]
    got = wide_simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2]
