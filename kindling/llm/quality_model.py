"""Quality by naive Bayes support vectors.

A text's n-gram indicators (tokens and adjacent pairs, hashed; a token that repeats the one
before it is a pair of its own kind) are scaled by the class log-count ratio of each. A linear
hinge-loss model over them is fitted by dual coordinate descent on a bounded labelled sample,
and a logistic curve fitted on rows held back turns margins into scores. Labels, language,
source and doc_id are no inputs. All rows are scored, whole texts.

Edge cases: a null or empty text has no indicators and gets the score of the intercept. A null
doc_id is not held out. Very long texts are taken whole and weigh by all their indicators. Without labels of both kinds every score is the share of good labels,
or 0.5 if there are none. Repeated rows get equal scores; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import labelled, pick
from kindling.llm.toxicity import verdicts

#: Labelled rows that are learned from, about; the bound holds in expectation.
SAMPLE_ROWS = 10_000
FEATURES = 1 << 18
SMOOTHING, COST, EPOCHS = 1.0, 0.05, 8
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")
TWICE = 1  # the feature of a token that repeats the one before it
MEMO_ROWS = 500_000


def grams(text: str, memo: dict[str, int]) -> np.ndarray:
    """The distinct features of a text, sorted."""
    tokens = TOKEN.findall(text)
    for t in set(tokens).difference(memo):
        memo[t] = zlib.crc32(t.encode("utf-8", "replace"))
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    if len(memo) > MEMO_ROWS:
        memo.clear()
    pairs = np.where(h[:-1] == h[1:], TWICE, (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) >> np.uint64(7)) if len(h) > 1 else h[:0]
    return np.unique(np.concatenate((h, pairs)) & np.uint64(FEATURES - 1)).astype(np.int32)


def indicators(rows: DataFrame) -> DataFrame:
    """The other columns of `rows` and x, the features of its text."""

    def run(batches):
        memo: dict[str, int] = {}
        for b in batches:
            keep = [c for c in b.schema.names if c != "text"]
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                x = [grams((t or b"").decode("utf-8", "replace"), memo) for t in texts[i : i + 500]]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, len(x)) for c in keep), pa.array(x, pa.list_(pa.int32()))], [*keep, "x"])

    rows = rows.withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text") + ", x array<int>")


def dual_descent(xs: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model; y is 1 or -1."""
    w, bias, alpha, draw = np.zeros(len(scale)), 0.0, np.zeros(len(xs)), np.random.default_rng(seed)
    values = [scale[x] for x in xs]
    norms = np.array([v @ v + 1.0 for v in values])
    # the rarer class counts as much as the other
    share = (y > 0).mean()
    most = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * cost
    for _ in range(epochs):
        for i in draw.permutation(len(xs)):
            x, v = xs[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), most[i])
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w[x] += step * v
                bias += step
    return w, bias


class Model:
    def __init__(self, xs: list[np.ndarray], y: np.ndarray):
        self.flat, self.weights = float(y.mean()) if len(y) else 0.5, None
        held = np.arange(len(y)) % 5 == 0
        fit = np.flatnonzero(~held)
        if not len(fit) or not 0 < y[fit].sum() < len(fit):
            return
        counts = [np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)]
        for i in fit:
            counts[int(y[i])][xs[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        w, bias = dual_descent([xs[i] for i in fit], np.where(y[fit] > 0, 1.0, -1.0), ratio, COST, EPOCHS)
        self.weights, self.bias = (w * ratio).astype(np.float32), bias
        self.slope, self.shift = self._curve(np.array([self.margin(xs[i]) for i in np.flatnonzero(held)]), y[held])

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) + self.bias

    @staticmethod
    def _curve(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
        """Logistic slope and shift by Newton steps, with smoothed targets."""
        if not len(m):
            return 1.0, 0.0
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            g, h = p - t, np.maximum(p * (1 - p), 1e-6)
            H = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
            da, db = np.linalg.solve(H, [(g * m).sum(), g.sum()])
            a, b = max(a - np.clip(da, -1, 1), 1e-2), b - np.clip(db, -1, 1)
        return float(a), float(b)

    def __call__(self, xs) -> np.ndarray:
        if self.weights is None:
            return np.full(len(xs), self.flat)
        m = np.array([self.margin(x) for x in xs])
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    own = pick(docs, "doc_id", "text").join(F.broadcast(labelled(labels, "quality", rows)), "doc_id")  # `rows` ids at most
    got = indicators(own.select("doc_id", "y", "text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "x").toArrow()
    xs = got.column("x").combine_chunks()
    flat, ends = xs.flatten().to_numpy(), np.cumsum([0, *xs.value_lengths().to_pylist()]) if len(xs) else [0]
    return Model([flat[a:b] for a, b in zip(ends, ends[1:])], got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        memo: dict[str, int] = {}
        for b in batches:
            got = model([grams((t or b"").decode("utf-8", "replace"), memo) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    return verdicts(score(docs, train(docs, labels)), threshold)
