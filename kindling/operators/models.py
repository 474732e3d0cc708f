"""Models by spark.ml, with the missing values, weights and offsets the pipelines need."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """With x, the features as a vector: nulls at their median, each flagged."""
    flagged = df.withColumns({f"{f}_void": F.col(f).isNull().cast("double") for f in features})
    filled = Imputer(strategy="median", inputCols=features, outputCols=[f"{f}_full" for f in features]).fit(flagged).transform(flagged)
    return VectorAssembler(inputCols=[f"{f}_full" for f in features] + [f"{f}_void" for f in features], outputCol="x").transform(filled)


def poisson_glm(df: DataFrame, features: list[str], label: str, offset: str, ridge: float = 0.01) -> DataFrame:
    """df with lam, the expected count, and p, the chance of at least one."""
    rows = assembled(df, features)
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol=label, offsetCol=offset, regParam=ridge, predictionCol="lam", maxIter=50)
    return glm.fit(rows).transform(rows).withColumn("p", 1 - F.exp(-F.col("lam"))).select(*df.columns, "lam", "p")


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """df with calibrated, a non-decreasing function of the score."""
    rows = VectorAssembler(inputCols=[score], outputCol="x").transform(df)
    return IsotonicRegression(featuresCol="x", labelCol=label, predictionCol="calibrated").fit(rows).transform(rows).select(*df.columns, "calibrated")


def logistic(df: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = assembled(df, features)
    steps = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol=label, regParam=0.01)])
    return steps.fit(rows).transform(rows).select(*df.columns, vector_to_array("probability")[1].alias("p"))


def out_of_fold_trees(df: DataFrame, features: list[str], label: str, fold: str, folds: int) -> DataFrame:
    """df with oof, each row predicted by trees that never saw its fold."""
    rows, out = assembled(df, features), None
    for k in range(folds):
        model = GBTRegressor(featuresCol="x", labelCol=label, predictionCol="oof", maxIter=10, maxDepth=3, seed=7).fit(rows.where(F.col(fold) != k))
        part = model.transform(rows.where(F.col(fold) == k)).select(*df.columns, "oof")
        out = part if out is None else out.unionByName(part)
    return out


def clusters(df: DataFrame, vector: str, k: int, parts: int) -> DataFrame:
    """df with cluster and the first principal components of an array column."""
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("x", array_to_vector(F.col(vector).cast("array<double>")))
    steps = Pipeline(stages=[KMeans(featuresCol="x", predictionCol="cluster", k=k, seed=7, maxIter=10), PCA(k=parts, inputCol="x", outputCol="pc")])
    return steps.fit(rows).transform(rows).select(*df.columns, "cluster", vector_to_array("pc").alias("pc"))
