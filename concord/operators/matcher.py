"""The pair classifier: boosted trees over the pair features."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.schema import PAIR_FEATURES

MODEL_FEATURES = [*PAIR_FEATURES, "candidate_is_source3"]


def model_features(features: DataFrame) -> DataFrame:
    """``features`` with candidate_is_source3; ValueError where a candidate is in neither source 2 nor 3."""
    source = F.col("candidate_source")
    checked = F.when(source.isin("source2", "source3"), (source == "source3").cast("int")).otherwise(F.raise_error(F.concat(F.lit("candidate in "), F.coalesce(source, F.lit("no source")))).cast("int"))
    return features.withColumn("candidate_is_source3", checked)


def balanced(sample: DataFrame) -> DataFrame:
    """``sample`` with weight: each class weighs half of all."""
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"training needs pairs of both labels; found {counts}")
    total = sum(counts.values())
    return sample.withColumn("weight", F.when(F.col("label") == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0])))


def fit(sample: DataFrame, max_iter: int = 160, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=max_iter, stepSize=0.08, maxDepth=5, maxBins=255, minInstancesPerNode=20, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(balanced(model_features(sample)))


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``features`` with probability; an error where it isn't finite."""
    scored = model.transform(model_features(features)).withColumn("probability", vector_to_array("probability")[1])
    finite = F.col("probability").isNotNull() & ~F.isnan("probability") & (F.abs("probability") < float("inf"))
    return scored.withColumn("probability", F.when(finite, F.col("probability")).otherwise(F.raise_error(F.lit("probability isn't finite")).cast("double"))).drop("features", "rawPrediction", "prediction")


@dataclass(frozen=True)
class TrainingSummary:
    threshold: float
    macro_f05: float
    candidate_recall: float
    train_pairs: int
    train_positives: int
    validation_pairs: int
    validation_positives: int
    n_entities: int
    n_links: int


def save(model: PipelineModel, summary: TrainingSummary, path: str) -> None:
    """The model and one row of metadata, each written whole before it counts."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"features": MODEL_FEATURES, **asdict(summary)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    """The model and its threshold; ValueError if its features or threshold aren't those expected."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta.get("features") != MODEL_FEATURES:
        raise ValueError("the model was trained on other features")
    if not 0 <= meta.get("threshold", -1) <= 1:
        raise ValueError("the model's threshold isn't in [0, 1]")
    return PipelineModel.load(f"{path}/model"), meta["threshold"]
