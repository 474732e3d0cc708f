"""Where a block's pairs are tested, and how it is dealt, changes no result."""

import numpy as np
import pytest

from kindling.llm import wide_simhash


@pytest.mark.parametrize("crowded, tile", [(1, 4), (1, 256), (10**9, 256)])
def test_blocks_of_texts_that_share_a_passage(spark, crowded, tile, monkeypatch):
    monkeypatch.setattr(wide_simhash, "CROWDED", crowded)
    monkeypatch.setattr(wide_simhash, "TILE", tile)
    draw = np.random.default_rng(4)
    passage = [f"p{x}" for x in draw.integers(0, 10**9, 200)]
    rows = []
    for i in range(60):  # similar at about 0.5, so none is a near copy of another's original; every third has a copy
        words = passage + [f"w{x}" for x in draw.integers(0, 10**9, 100)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            rows.append((100 + i, " ".join([*words, "end"])))
    got = {r.doc_id: r.component_id for r in wide_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i % 100 for i, _ in rows}
