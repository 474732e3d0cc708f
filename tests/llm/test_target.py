"""The target of the quality rules covers every row labelled good."""

import zlib

from pyspark.sql import functions as F

from kindling.llm import quality_rules


def test_target_is_not_sampled(spark):
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2]  # rows that may be learned from
    docs = spark.createDataFrame([(i, f"text {i} of its own") for i in ids], "doc_id long, text string")
    labels = spark.range(900_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert not quality_rules.log_ratios(docs, labels).any()  # all rows are good: target and raw counts are equal
