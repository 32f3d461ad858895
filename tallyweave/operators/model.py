"""Pair classifiers: two boosted-tree models, their blend, and diagnostics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .pairs import FEATURES


def classifier(kind: str = "first", rounds: int = 20, seed: int = 42, features=FEATURES) -> Pipeline:
    """`first`: shallower trees with larger leaves; `second`: deeper ones with more bins."""
    settings = {
        "first": {"maxDepth": 6, "minInstancesPerNode": 40, "maxBins": 64},
        "second": {"maxDepth": 7, "minInstancesPerNode": 8, "maxBins": 256},
    }[kind]
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=rounds, stepSize=0.045 if rounds > 100 else 0.2, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed, **settings
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees])


def fit(labelled: DataFrame, kind: str = "first", rounds: int = 20, seed: int = 42, features=FEATURES) -> PipelineModel:
    """labelled: the features and `label` (0.0 or 1.0)."""
    return classifier(kind, rounds, seed, features).fit(labelled.withColumn("label", F.col("label").cast("double")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel | None, pairs: DataFrame, name: str = "p") -> DataFrame:
    if model is None:
        raise RuntimeError("the classifier is not fitted")
    out = model.transform(pairs).withColumn(name, vector_to_array("probability")[1].cast("float"))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def blend(first: Column, second: Column, weight: float) -> Column:
    return ((1 - weight) * first + weight * second).cast("float")


def importance(model: PipelineModel, features=FEATURES) -> list[tuple[str, float]]:
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, gains), key=lambda x: (-x[1], x[0]))


def country_transfer(labelled: DataFrame, queries: DataFrame, truth: DataFrame, threshold: float, rounds: int = 10, features=FEATURES) -> dict[str, dict]:
    """For each country: fitted on the fit split of the others, measured on its own holdout.

    labelled: query_id, row_id, country, split, label and the features."""
    out = {}
    for (country,) in sorted(tuple(r) for r in queries.select("country").distinct().collect()):
        train = labelled.filter((F.col("split") == "fit") & (F.col("country") != country))
        own = queries.filter((F.col("split") == "holdout") & (F.col("country") == country))
        kinds = train.agg(F.count_distinct("label")).first()[0]
        if kinds < 2 or not own.limit(1).count():
            continue
        model = fit(train, "first", rounds, features=features)
        pairs = score(model, labelled.join(own.select("query_id"), "query_id", "left_semi"))
        held = metrics.per_query(own.select("query_id"), truth.join(own.select("query_id"), "query_id", "left_semi"), pairs, threshold)
        out[country] = metrics.report(held).first().asDict()
    return out
