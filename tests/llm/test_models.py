"""The classifiers' parts against brute force, and their scores recomputed outside Spark."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.llm import quality_model, toxicity
from kindling.llm.trees import Isotonic, Trees


def test_first_split_is_the_best_of_all():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + draw.normal(0, 2, 300) > 6).astype(float)
    model = Trees(depth=1, rounds=1, bins=64).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))

    def gain(left):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        ok = h[left].sum() > 1 and h[~left].sum() > 1
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + 1.0) if ok else 0.0

    best = max(gain(x[:, j] <= v) for j in range(3) for v in np.unique(x[:, j]))
    feature, edge, value = model.trees[0]
    left = x[:, feature[0]] <= edge[0]
    assert gain(left) == pytest.approx(best)
    for side, leaf in ((left, 0), (~left, 1)):
        assert value[leaf] == pytest.approx(0.15 * g[side].sum() / (h[side].sum() + 1.0))
    assert np.allclose(model.raw(x), model.base + np.where(left, value[0], value[1]))


def test_more_rounds_lower_the_loss():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    loss = lambda n: np.log1p(np.exp(-np.where(y > 0, 1, -1) * Trees(rounds=n).fit(x, y).raw(x))).mean()
    assert loss(80) < loss(20) < loss(1)


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_blocks_are_the_least_squares_fit(seed):
    draw = np.random.default_rng(seed)
    score, y = draw.permutation(40).astype(float), draw.integers(0, 2, 40).astype(float)
    v = y[np.argsort(score)]
    n = len(v)
    # the monotone fit at a place is the largest, over beginnings up to it, of the least mean, over ends from it
    mean = lambda a, b: v[a:b].mean()
    fit = np.array([max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)])
    got = Isotonic().fit(score, y)(np.arange(n, dtype=float))
    assert (np.diff(got) >= 0).all()
    for block in np.split(np.arange(n), np.flatnonzero(np.diff(fit) > 1e-12) + 1):
        k, s = len(block), v[block].sum()
        assert got[block] == pytest.approx(np.full(k, (s + 0.5) / (k + 1) if k > 1 else s), abs=0.5)  # the ends keep away from 0 and 1
        assert np.ptp(got[block]) < 1e-12


def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(3)
    xs = [np.flatnonzero(draw.random(12) < 0.4).astype(np.int32) for _ in range(60)]
    y = np.array([1.0 if 3 in x or 5 in x else -1.0 for x in xs]) * np.where(draw.random(60) < 0.1, -1, 1)
    scale, cost = draw.normal(size=12), 0.3
    w, b = quality_model.dual_descent(xs, y, scale, cost, 3000)
    dense = np.zeros((60, 13))
    for i, x in enumerate(xs):
        dense[i, x] = scale[x]
    dense[:, 12] = 1.0  # the intercept is a weight like any other
    share = (y > 0).mean()
    most = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * cost
    primal = lambda u: 0.5 * u @ u + (most * np.maximum(0, 1 - y * (dense @ u))).sum()
    # projected gradient on the dual is the second implementation
    q = (y[:, None] * dense) @ (y[:, None] * dense).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    u = np.concatenate((w, [b]))
    assert primal(u) >= dual - 1e-6 and primal(u) == pytest.approx(dual, rel=1e-3)


def made(spark):
    n = 240
    texts = {i: f"text {i} " + ("you idiot" if i % 4 == 0 else "all well") + " ***" * (i % 3 == 0) for i in range(n)} | {n: None, n + 1: "", n + 2: "text 3 all well ***", n + 3: "you idiot " * 30_000}
    rows = [(i, t, "de") for i, t in texts.items()] + [(None, "text 4 you idiot", "en"), (3, texts[3], "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_scores_and_edge_cases(spark, module, label):
    docs, labels, rows = made(spark)
    run = toxicity.toxicity if module is toxicity else quality_model.quality
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and {type(r.score) for r in got} == {float} and all(r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    assert of[240][0].score == of[241][0].score  # null counts as empty
    assert len(of[3]) == 2 and of[3][0].score == of[3][1].score == of[242][0].score or module is toxicity
    assert of[3][0].score == of[3][1].score and not of[None][0].held_out
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, rs in of.items() if i is not None for r in rs)
    model = module.train(docs, labels)
    texts = {i: t for i, t, _ in rows if i is not None}
    for i in (0, 1, 7, 240, 243):
        if module is toxicity:
            want = model(np.array([toxicity.features(texts[i] or "", model.lexicon)]))[0]
        else:
            want = model([quality_model.grams(texts[i] or "", {})])[0]
        assert of[i][0].score == pytest.approx(want)
    held = [r for i, rs in of.items() if i is not None and i < 240 for r in rs if r.held_out]
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9


def test_held_out_labels_are_never_learned_from(spark):
    docs, labels, _ = made(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b
