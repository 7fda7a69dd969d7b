"""Gradient-boosted trees on pair features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.schema import FEATURES


def fit(pairs: DataFrame, features: tuple = FEATURES, trees: int = 60, rate: float = 0.05, depth: int = 5, least: int = 50, seed: int = 42) -> PipelineModel:
    trees_ = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees_]).fit(pairs.select(*features, F.col("label").cast("double").alias("label")))


def scored(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    """rows of features with the probability of a match."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias(name))


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score)."""
    return scored(model, pairs).select("s1_id", "cand_id", "score")


def expression(model: PipelineModel, features: tuple = FEATURES) -> str:
    """The score as one SQL expression over the features: each tree is a CASE, their weighted sum goes through a logistic."""
    boosted = model.stages[-1]

    def one(node) -> str:
        if node.subtreeDepth() == 0:
            return f"CAST({node.prediction()!r} AS DOUBLE)"
        split = node.split()
        return f"(CASE WHEN {features[split.featureIndex()]} <= CAST({split.threshold()!r} AS DOUBLE) THEN {one(node.leftChild())} ELSE {one(node.rightChild())} END)"

    total = " + ".join(f"CAST({w!r} AS DOUBLE) * {one(t._call_java('rootNode'))}" for t, w in zip(boosted.trees, boosted.treeWeights))
    return f"1.0 / (1.0 + exp(-2.0 * ({total})))"


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
