"""Train-on-synthetic, test-on-real tasks: a flow classifier and a flow regressor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import materialize

# Hidden units of the classifier.
HIDDEN = 50


@dataclass
class Task:
    """Scaler fitted on train and test together, and the model fitted on train."""

    scaler: object
    model: object

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.scaler.transform(rows))


def _scaler(train: DataFrame, test: DataFrame, inputs: list[str]):
    both = train.select(*inputs).unionByName(test.select(*inputs))
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="raw_features"),
        MinMaxScaler(inputCol="raw_features", outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(both)


def _prepared(scaler, train: DataFrame, label: str) -> DataFrame:
    """Training rows computed once; every iteration reads them again."""
    return materialize(scaler.transform(train).select("features", label))


def flow_classifier(
    train: DataFrame, test: DataFrame, inputs: list[str], label: str, classes: int = 3, epochs: int = 100, seed: int = 1
) -> Task:
    """One hidden layer of 50 units; the hidden units are sigmoid, Spark's only kind."""
    scaler = _scaler(train, test, inputs)
    net = MultilayerPerceptronClassifier(
        layers=[len(inputs), HIDDEN, classes], labelCol=label, maxIter=epochs, seed=seed
    )
    return Task(scaler, net.fit(_prepared(scaler, train, label)))


def flow_regressor(
    train: DataFrame, test: DataFrame, inputs: list[str], label: str, rounds: int = 20, seed: int = 1
) -> Task:
    """Boosted trees in place of a network: Spark has no network regressor."""
    scaler = _scaler(train, test, inputs)
    trees = GBTRegressor(labelCol=label, maxIter=rounds, seed=seed)
    return Task(scaler, trees.fit(_prepared(scaler, train, label)))


def accuracy(predicted: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(predicted)


def mean_squared_error(predicted: DataFrame, label: str) -> float:
    return RegressionEvaluator(labelCol=label, metricName="mse").evaluate(predicted)


def classification_table(predicted: DataFrame, label: str) -> DataFrame:
    """Rows per true and predicted class."""
    return predicted.groupBy(
        F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")
    ).agg(F.count("*").alias("rows"))
