"""Texts that share a template and lie just below the similarity of a link are told apart before their shingles are compared."""

import numpy as np

from kindling.llm import wide_simhash


def test_pairs_below_the_threshold_are_not_compared(spark, monkeypatch):
    """200 texts, each at 0.86 or so of a template that isn't there, so at about 0.75 of one another; every tenth has a copy at 0.9."""
    compared, alike = [], wide_simhash.alike
    monkeypatch.setattr(wide_simhash, "alike", lambda pairs, *rest: compared.append(pairs.distinct().count()) or alike(pairs, *rest))
    draw = np.random.default_rng(7)
    template, rows = [f"t{x}" for x in range(150)], []
    for i in range(200):
        words, at = list(template), draw.integers(0, 130)
        words[at : at + 16] = [f"w{x}" for x in draw.integers(0, 10**9, 16)]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words, *"abcde"])))
    sets = {i: set(wide_simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    pairs = [(i, k) for i in sets for k in sets if i < k and 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])]
    root = {i: i for i in sets}
    while moved := [(i, k) for i, k in pairs if root[i] != root[k]]:
        for i, k in moved:
            root[i] = root[k] = min(root[i], root[k])
    got = {r.doc_id: r.component_id for r in wide_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == root and len(set(root.values())) > 20
    assert sum(compared) < 2 * len(pairs) + len(rows)


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Sets of up to 3,000 shingles, also empty ones and those whose hashes meet in few bits, at 0.8 or just above."""
    draw, rows = np.random.default_rng(8), []
    for own in [0, 1, 5, 9, 90, 270, 900, 3000]:
        for narrow in (False, True):
            for _ in range(10):
                shared = -(-8 * own // 9)
                x = draw.integers(0, 1 << 63, 2 * own - shared, dtype=np.uint64)
                if narrow:
                    x = x // np.uint64(1024) * np.uint64(1024) + x % np.uint64(7)
                a, b = np.unique(x[:own]), np.unique(x[own - shared :])
                rows.append([[0] * wide_simhash.WORDS + [int(v) for v in wide_simhash.shape_of(s)] for s in (a, b)])
    pairs = spark.createDataFrame(rows, "w1 array<long>, w2 array<long>")
    assert pairs.where(~wide_simhash._can_reach("w1", "w2")).count() == 0
    apart = [[[0] * wide_simhash.WORDS + [int(v) for v in wide_simhash.shape_of(draw.integers(0, 1 << 63, 200, dtype=np.uint64))] for _ in range(2)] for _ in range(10)]
    assert spark.createDataFrame(apart, "w1 array<long>, w2 array<long>").where(wide_simhash._can_reach("w1", "w2")).count() == 0
