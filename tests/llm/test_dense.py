"""Blocks of very many texts that share a template: what meets doesn't grow with their square, and every link is found."""

import numpy as np
import pytest

from kindling.llm import wide_simhash


def linked(sets: dict) -> dict:
    pairs = [(i, k) for i in sets for k in sets if i < k and 9 * len(sets[i] & sets[k]) >= 4 * (len(sets[i]) + len(sets[k]))]
    root = {i: i for i in sets}
    while moved := [(i, k) for i, k in pairs if root[i] != root[k]]:
        for i, k in moved:
            root[i] = root[k] = min(root[i], root[k])
    return root


@pytest.mark.parametrize("tile", [8, 256])
def test_a_crowd_about_a_template(spark, tile, monkeypatch):
    """300 texts with 0 to 40 % of a template's words replaced and some words more at the end; every tenth has a copy."""
    monkeypatch.setattr(wide_simhash, "CROWDED", 4)
    monkeypatch.setattr(wide_simhash, "DENSE", 8, raising=False)
    monkeypatch.setattr(wide_simhash, "TILE", tile)
    tested, candidates = [], wide_simhash._candidates
    monkeypatch.setattr(wide_simhash, "_candidates", lambda pairs: tested.append(pairs.count()) or candidates(pairs))
    draw = np.random.default_rng(5)
    template, rows = [f"t{x}" for x in range(150)], []
    for i in range(300):
        words = list(template)
        for at in draw.choice(30, draw.integers(0, 13), replace=False):
            words[5 * at : 5 * at + 5] = [f"w{x}" for x in draw.integers(0, 10**9, 5)]
        words += [f"e{x}" for x in range(i % 15)]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words, *"abcde"])))
    sets = {i: set(wide_simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    root = linked(sets)
    got = {r.doc_id: r.component_id for r in wide_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == root and len(set(root.values())) > 100
    assert sum(tested) < 5 * len(rows), tested


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_the_rarest_shingles_of_a_pair_meet(spark, tile, monkeypatch):
    """Sets of 1 to 300 shingles out of few, with partners at 0.8 or just above: none of those is left out, nor is it by size or tile."""
    monkeypatch.setattr(wide_simhash, "TILE", tile)
    draw, rows = np.random.default_rng(6), [(0, 0, [])]
    for own in [1, 2, 4, 5, 9, 10, 45, 90, 300]:
        pool = draw.integers(-(1 << 63), 1 << 63, 2 * own, dtype=np.int64)
        for _ in range(12):
            x = draw.permutation(pool)[:own]
            less = x[: -(-4 * own // 5)]  # a part of 0.8
            swapped = np.concatenate([x[: -(-8 * own // 9)], draw.integers(-(1 << 63), 1 << 63, own - -(-8 * own // 9), dtype=np.int64)])
            for y in (x, less, swapped):
                rows.append((len(rows), len(rows), [int(v) for v in np.unique(y)]))
    sets = {i: set(s) for i, _, s in rows}
    due = {(i, k) for i in sets for k in sets if i < k and sets[i] and sets[k] and 9 * len(sets[i] & sets[k]) >= 4 * (len(sets[i]) + len(sets[k]))}
    got = [(r.u, r.v) for r in wide_simhash._sharing(wide_simhash._rarest(spark.createDataFrame(rows, "node long, root long, set array<long>"))).collect()]
    assert len(set(got)) == len(got) and due <= set(got) and len(due) > 300
