"""Queries that fit a model; their rows have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindling.operators import models
from kindling.plans.common import registry, table

QUERIES, ORACLES, query = registry()


def _counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("y"), F.avg("value").alias("v"), F.max("value").alias("top")).withColumn("o", F.log(F.lit(2.0)))


@query()
def glm_poisson_offset(spark, sf_dir):
    return models.poisson_glm(_counts(spark, sf_dir), ["v", "top"], "y", "o").select("user_id", "day", "lam", "p")


@query()
def isotonic_fit(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") > 30000).cast("double").alias("y"))
    return models.isotonic(x, "l_quantity", "y").groupBy("l_quantity").agg(F.first("calibrated").alias("calibrated"), F.count("*").alias("n"))


@query()
def logistic_imputed(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"), "l_tax", (F.col("l_extendedprice") > 30000).cast("double").alias("y"))
    return models.logistic(x, ["q", "l_tax"], "y").select("l_orderkey", "l_linenumber", "p")


@query()
def gbt_oof(spark, sf_dir):
    x = _counts(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("user_id"), F.lit(3)).cast("int"))
    return models.out_of_fold_trees(x, ["v", "top"], "y", "fold", 3).select("user_id", "day", "fold", "oof")


@query()
def kmeans_pca(spark, sf_dir):
    return models.clusters(table(spark, sf_dir, "embeddings"), "embedding", 4, 2).select("vec_id", "cluster", "pc")
