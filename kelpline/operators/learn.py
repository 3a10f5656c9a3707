"""Classifiers on feature arrays, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label").cast("double")).withColumn("vector", array_to_vector("features"))


def train(train_rows: DataFrame, hidden: int | None = None, max_iter: int = 30, seed: int = 0):
    """Multinomial logistic regression, or a perceptron with one layer of ``hidden`` units."""
    rows = vectors(train_rows)
    if hidden is None:
        return LogisticRegression(featuresCol="vector", maxIter=max_iter, regParam=0.01).fit(rows)
    width = train_rows.select(F.size("features")).first()[0]
    classes = int(train_rows.agg(F.max("label")).first()[0]) + 1
    return MultilayerPerceptronClassifier(featuresCol="vector", layers=[width, hidden, classes], maxIter=max_iter, seed=seed).fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """id, label, pred."""
    return model.transform(vectors(rows)).select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


def tune(rows: DataFrame, reg: tuple[float, ...] = (0.001, 0.01, 0.1), seed: int = 0) -> list[tuple[float, float]]:
    """Accuracy on a held-out fifth for each strength of regularisation."""
    model = LogisticRegression(featuresCol="vector", maxIter=20)
    grid = ParamGridBuilder().addGrid(model.regParam, list(reg)).build()
    split = TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), trainRatio=0.8, parallelism=2, seed=seed)
    return list(zip(reg, split.fit(vectors(rows)).validationMetrics))


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    """A model that ``save`` wrote, of whatever kind it is."""
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())
