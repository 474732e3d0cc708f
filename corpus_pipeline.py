"""From raw documents to tokens: each stage works on the rows that the one before it kept.

Quality rules drop poor rows, exact dedup and near dedup leave one document of each group,
mixing repeats or drops rows until each source has its weight, and the last stage encodes
what is left. Stages are written as Parquet in the shared folder and read again.

Edge cases: null and empty texts fail the quality rules. Rows are told apart by row, not by id: rows that repeat id and text
leave one, null ids are judged like any other and never take each other along. Very long texts pass all stages whole,
except where a source's budget ends within one. Extra columns go along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindling.llm import bpe, exact_dedup, mixing, quality_rules, wide_simhash
from kindling.llm.common import cut, table
from kindling.llm.queries import vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_poor(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wide_simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, vocabulary())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("bpe", tokens)]
#: The rules' model and the hashes that order the mix have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
