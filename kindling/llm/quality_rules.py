"""Quality rules in DataFrame operations only.

Two rules per document come first (few words, repeated 8-word windows). The others are
judged by a log-likelihood ratio: tokens (runs of letters and digits, runs of other marks)
and adjacent pairs of them are hashed into BUCKETS, one multinomial is counted over the
trusted target and one over the whole raw corpus, and a document's score is the mean
log-ratio of its n-grams. It is kept at THRESHOLD or above; nothing is drawn at random.

The target is all rows labelled good that may be learned from; the raw counts cover all rows. Without any target the ratio is zero and only the two rules hold.

Edge cases: a null or empty text has no words and fails. Repeated rows get equal results. A
very long text is measured whole. A score at the threshold is kept, ties with it alike; a null doc_id has no label and is judged like any other.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import bounded, flat, labelled, let, pick, words

BUCKETS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.25
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
SYMBOLS = r"[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def grams(text: Column) -> Column:
    """The hashes of a text's tokens and of its adjacent pairs of tokens."""
    hashed = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def both(h):
        pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.concat(h, pairs)

    return let(hashed, both)


def bucket(x: Column) -> Column:
    return x.bitwiseAND(BUCKETS - 1).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log-ratio of each bucket, from counts over all of `docs`. BUCKETS numbers reach the driver."""
    good = labelled(labels, "quality").where("y = 1").select("doc_id", F.lit(1).alias("good"))
    rows = pick(docs, "doc_id", "text").join(bounded(good, good.count()), "doc_id", "left")
    listed = rows.select("good", F.explode(grams(F.col("text"))).alias("gram"))
    counts = listed.groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("n"), F.count("good").alias("t"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.n, r.t
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target) / share(raw))


def windows(w: Column, window: int) -> Column:
    """A hash of each run of `window` words: hashes of shorter runs are joined until they span it."""

    def joined(step):
        def both(h):
            n = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

        return both

    hashed, width = F.transform(w, lambda x: F.xxhash64(x)), 1
    while width < window:
        step = min(width, window - width)
        hashed, width = let(hashed, joined(step)), width + step
    return hashed


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window that the array `w` holds twice or more."""
    hashed = windows(w, window)

    def spread(s):  # sorted (hash, place): equal hashes stand side by side
        twin = lambda x, i, d: F.coalesce(x["h"] == F.get(s, i + d)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: twin(x, i, -1) | twin(x, i, 1)), lambda x: x["i"]))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b)

    def count(h):
        places = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spread)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(places, covered)).otherwise(F.lit(0))

    return F.when(F.size(w) >= window, let(hashed, count)).otherwise(F.lit(0))


def _measured(df: DataFrame, text: Column, ratios: np.ndarray) -> DataFrame:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    table = F.from_json(F.lit("[" + ",".join(f"{x:.12g}" for x in ratios) + "]"), "array<double>")  # folded to a constant
    score = let(grams(t), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, bucket(b))) / F.greatest(F.size(g), F.lit(1)))
    df = df.withColumns({"w_": words(t), "lines_": lines})
    df = df.withColumns(
        {
            "n_words": F.size("w_").cast("long"),
            "word_chars": F.length(F.concat_ws("", "w_")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("w_")).cast("long"),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return df.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, score and kept."""
    rows = _measured(pick(docs, "doc_id", "text"), F.col("text"), log_ratios(docs, labels))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns."""
    frame, at = flat(docs)
    rows = _measured(frame, at["text"], log_ratios(docs, labels))
    # A filter pushed below the projections would split the text again for each window of it; one
    # that uses a column which isn't deterministic stays above them.
    kept = rows.withColumn("row_", F.monotonically_increasing_id()).where("kept and row_ >= 0")
    return kept.select(*frame.columns).toDF(*docs.columns)
