"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a fixed lexicon and of one learned from labelled rows (words and
word beginnings), how near its words stand to a second person, and rates of capitals, of
punctuation and of obfuscation. One half of a bounded labelled sample gives the lexicon; the
other fits the trees and, on a part held back, the calibration. Labels, language, source and
doc_id are no inputs. All rows are scored, whole texts.

Edge cases: a null or empty text gets the score of a text without words. A null doc_id is not
held out. Very long texts are measured whole. Without labels of both kinds every score is the share of toxic labels, or 0 if there
are none. Repeated rows get equal scores; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import cut, labelled, pick, remainder
from kindling.llm.trees import Isotonic, Trees

#: Labelled rows that are learned from, about; the bound holds in expectation.
SAMPLE_ROWS = 30_000
#: Entries of the learned lexicon, and documents that an entry must be in.
LEXICON_ROWS, LEXICON_DOCS, LEXICON_RATIO = 2_000, 8, 12.0
THRESHOLD = 0.3
NEAR = 6
#: Lengths of word beginnings in the learned lexicon; only of longer words.
STARTS = (5, 4)
# Insults in common use, and second persons in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless trash garbage scum clown clowns disgusting jerk creep freak bastard bitch asshole crap shit fuck fucking bullshit retard imbecile fool vermin filth hate kill".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W\d_]+")
#: Words with a digit or a sign in them, each looked at from its start only, and the parts of them that may be masked words.
RUN, PART = re.compile(r"(?<![\w@$*!])[^\W\d_]*[\d_@$*!][\w@$*!]*"), re.compile(r"[a-z0-9@$*!]{3,}")
SPACED = re.compile(r"\b(?:[a-z][.\-_* ]){3,}[a-z]\b")
MARKS = re.compile(r"[^\w\s]")


def masked(low: str) -> list[str]:
    """Parts of a lower-cased text in which digits or signs may stand for letters: at or behind their start the word has both kinds."""
    out = []
    for run in RUN.findall(low):
        sign = max(map(run.rfind, "0123456789@$*!"))
        letter = next((i for i in range(len(run) - 1, -1, -1) if "a" <= run[i] <= "z"), -1)
        out += [m.group() for m in PART.finditer(run) if m.start() <= min(sign, letter)]
    return out


def features(text: str, lexicon: frozenset[str]) -> list[float]:
    low = text.lower()
    found = WORD.findall(low)
    n, chars = max(1, len(found)), max(1, len(text))
    fixed = [i for i, w in enumerate(found) if w in INSULTS]
    learned = [i for i, w in enumerate(found) if w in lexicon or any(len(w) > k and w[:k] + "*" in lexicon for k in STARTS)]
    hits, near = sorted({*fixed, *learned}), 0
    for i in hits:
        near += any(w in SECOND for w in found[max(0, i - NEAR) : i + NEAR + 1])
    hidden = [w.translate(LEET) for w in masked(low)] if any(c in low for c in "0123456789@$*!") else []
    masked_hits = sum(w.strip("*!") in INSULTS for w in hidden)
    upper = sum(map(str.isupper, text.split()))
    return [
        len(fixed) / n, np.log1p(len(fixed)), len(learned) / n, np.log1p(len(learned)), len(hits) / n, len({found[i] for i in hits}), near / n, near,
        upper / n, sum(1 for c in text if c.isupper()) / chars if upper else 0.0, len(MARKS.findall(text)) / chars, text.count("!") / n, text.count("?") / n,
        len(hidden) / n, masked_hits / n, len(SPACED.findall(low)) / n, np.log1p(len(found)),
    ]


WIDTH = len(features("", frozenset()))


def units(text: str) -> set[str]:
    """The distinct words of a text, and the beginnings of its longer words."""
    found = set(WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in STARTS if len(w) > k}


def learn_lexicon(rows: DataFrame) -> frozenset[str]:
    """Words and beginnings (ending in *) that toxic rows (text, y) have far oftener. At most LEXICON_ROWS reach the driver."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([list(units((t or b"").decode("utf-8", "replace"))) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["y", "units"])

    rows = cut(rows.select("y", F.col("text").cast("binary").alias("text")).mapInArrow(run, "y int, units array<string>"))
    units_of = rows.select("y", F.explode("units").alias("unit"))
    toxic, all_rows = (float(x or 0) for x in rows.agg(F.sum("y"), F.count("*")).first())
    if not 0 < toxic < all_rows:
        return frozenset()
    ratio = (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 0.5) / (all_rows - toxic))
    best = units_of.groupBy("unit").agg(F.sum("y").alias("t"), F.count("*").alias("n")).where((F.col("t") >= LEXICON_DOCS) & (ratio >= LEXICON_RATIO))
    return frozenset(r.unit for r in best.orderBy(F.desc("t"), "unit").limit(LEXICON_ROWS).collect())


def measured(rows: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """The other columns of `rows` and x, the features of its text."""

    def run(batches):
        for b in batches:
            x = [features((t or b"").decode("utf-8", "replace"), lexicon) for t in b.column("text").to_pylist()]
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    rows = rows.withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text") + ", x array<double>")


class Model:
    def __init__(self, lexicon: frozenset[str], x: np.ndarray, y: np.ndarray):
        self.lexicon, self.flat, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        if 0 < y.sum() < len(y):
            held = np.arange(len(y)) % 3 == 0
            if not 0 < y[~held].sum() < (~held).sum() or not held.any():
                return
            self.trees = Trees().fit(x[~held], y[~held])
            self.steps = Isotonic().fit(self.trees.raw(x[held]), y[held])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.flat)
        raw = self.trees.raw(x)
        # a thousandth of the uncalibrated score keeps order within a step
        return np.clip(0.999 * self.steps(raw) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    own = pick(docs, "doc_id", "text").join(F.broadcast(labelled(labels, "toxic", rows)), "doc_id")  # `rows` ids at most
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    lexicon = learn_lexicon(own.where(half == 0).select("text", "y"))
    got = measured(own.where(half == 1).select("doc_id", "y", "text"), lexicon).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return Model(lexicon, np.array(got["x"].tolist(), float).reshape(-1, WIDTH), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for b in batches:
            x = np.array([features((t or b"").decode("utf-8", "replace"), model.lexicon) for t in b.column("text").to_pylist()], float).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model(x), pa.float64())], ["doc_id", "score"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    return verdicts(score(docs, train(docs, labels)), threshold)
