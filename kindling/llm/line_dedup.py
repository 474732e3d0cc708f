"""Line dedup in DataFrame operations only.

Lines travel as two 64-bit hashes with document and position. They are range-partitioned by
hash and sorted by document and position within it; one streaming pass marks each first
occurrence in a document. A key is split over SALTS ranges by document, so a line that a
third of all documents hold fills no single task; the marks are then summed over the
salts. Lines that go are returned as one bitmap of 64-bit words per document, words
without a set bit left out. Texts are read again; those that a sieve of the documents with a bitmap
rules out pass as they are, and only the others are shuffled to meet their bitmaps.

Edge cases: a null or empty text is one empty line. Rows of one doc_id are one document;
rows without doc_id together are one, smaller than any other. A line that a document repeats
stays at each place in its largest document. Very long texts and lines are taken whole. Repeated rows get equal
results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm.common import BLANKS, counted_join, cut, pick, sieved

SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is quick, and changes nothing but A-Z where all is ASCII
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _documents(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.where(F.octet_length("line") >= min_chars).select("id", "th", "pos", line_key(F.col("line")).alias("line_key"))
    keys = keys.where(F.length("line_key") >= min_chars)
    return keys.select("id", "th", "pos", F.xxhash64("line_key").alias("h1"), F.xxhash64(F.lit(7), "line_key").alias("h2"))


def bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """id, th and `bits`, the lines that go, for each document that loses any.

    `bits` is an array of (word, bits): line 64 * word + i goes if bit i is set.
    """
    lines = cut(_lines(docs, min_chars))
    ranged = lines.select("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("byte").alias("salt"), "id", "pos")
    ranged = ranged.repartitionByRange("h1", "h2", "salt")
    by = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("id").desc(), "pos")
    first = ranged.withColumn("first", F.coalesce(F.lag("id").over(by) != F.col("id"), F.lit(True)))
    keys = first.groupBy("h1", "h2").agg(F.count_if("first").alias("docs"), F.count("*").alias("n"), F.max("id").alias("owner")).where(F.col("docs") >= min_docs)
    gone = counted_join(lines, cut(keys.select("h1", "h2", "n", "owner")), ["h1", "h2"], lines.count()).where("id <> owner")
    word = F.floor(F.col("pos") / 64).cast("int")
    sets = gone.groupBy("id", "th", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return sets.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped and kept_text."""
    own = _documents(pick(docs, "doc_id", "text"))
    marks = cut(bitmaps(own, min_chars, min_docs))
    both = F.xxhash64("id", "th")
    told = sieved(own, both, marks, both)
    inside = F.expr("flatten(transform(bits, w -> transform(filter(sequence(0, 63), i -> shiftright(w.bits, i) & 1 = 1), i -> 64 * w.word + i)))")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
    whole = told.where("not maybe").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    rows = told.where("maybe").join(marks, ["id", "th"], "left").select("doc_id", "text", lines.alias("lines"), F.when(F.col("bits").isNotNull(), inside).alias("gone"))
    cut_rows = rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("kept_text"),
    )
    return whole.unionByName(cut_rows)
