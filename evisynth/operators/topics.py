"""Clusters and topics by Spark's own estimators, and calibration."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(rows: DataFrame, id_col: str, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    x = rows.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select(id_col, F.col("prediction").alias("cluster"))


def topics_and_citations(rows: DataFrame, id_col: str, tokens: str, target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Topics by LDA, then a linear model of log1p(target) on them: two stages in place of supervised topics. id_col, topic, predicted, residual."""
    x = rows.select(id_col, tokens, F.log1p(target).alias("y"))
    counts = CountVectorizer(inputCol=tokens, outputCol="counts", vocabSize=5000, minDF=2).fit(x).transform(x)
    mixed = LDA(k=k, seed=seed, maxIter=5, featuresCol="counts").fit(counts).transform(counts)
    model = LinearRegression(featuresCol="topicDistribution", labelCol="y", regParam=0.1, elasticNetParam=0.0).fit(mixed)
    out = model.transform(mixed)
    share = vector_to_array("topicDistribution")
    return out.select(id_col, (F.array_position(share, F.array_max(share)) - 1).cast("int").alias("topic"), F.col("prediction").alias("predicted"), (F.col("y") - F.col("prediction")).alias("residual"))


def fit_quality(rows: DataFrame, features: list[str], target: str, folds: int = 5) -> DataFrame:
    """R2 of a ridge model in each of `folds` hashed folds."""
    x = VectorAssembler(inputCols=features, outputCol="f").transform(rows.select(*features, F.col(target).alias("y"))).withColumn("fold", F.pmod(F.xxhash64(*features, "y"), F.lit(folds)))
    found = []
    for i in range(folds):
        test = LinearRegression(featuresCol="f", labelCol="y", regParam=1.0).fit(x.where(F.col("fold") != i)).transform(x.where(F.col("fold") == i))
        found.append((i, float(RegressionEvaluator(labelCol="y", metricName="r2").evaluate(test))))
    return rows.sparkSession.createDataFrame(found, "fold int, r2 double")


def isotonic(rows: DataFrame, score: str, label: str) -> DataFrame:
    """rows with `calibrated`, clipped to 0..1."""
    x = rows.withColumn("_f", F.col(score).cast("double")).withColumn("_y", F.col(label).cast("double"))
    out = IsotonicRegression(featuresCol="_f", labelCol="_y").fit(x.select("_f", "_y")).transform(x)
    return out.select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("calibrated"))


def platt(rows: DataFrame, score: str, label: str) -> DataFrame:
    """rows with `calibrated`: a logistic curve of the score, fitted without a penalty."""
    x = VectorAssembler(inputCols=["_s"], outputCol="_f").transform(rows.withColumn("_s", F.col(score).cast("double")).withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=100).fit(x.select("_f", "_y"))
    return model.transform(x).select(*rows.columns, vector_to_array("probability")[1].alias("calibrated"))
