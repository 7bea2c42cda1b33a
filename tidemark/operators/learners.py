"""Pooled tree models over lag, rolling and calendar features (M7, M8)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .features import calendar, lags, rolling


def pooled_features(df: DataFrame, column: str, key: str, horizon: int = 1) -> tuple[DataFrame, list[str]]:
    """Rows with features of the past and the value `horizon` rows later as label; rows without either are left out."""
    own = calendar(rolling(lags(df.select("date", key, column), [column], [1, 7, 14], [key]), [column], [7, 30], [key]))
    own = own.withColumn("label", F.lead(column, horizon).over(Window.partitionBy(key).orderBy("date")))
    names = [c for c in own.columns if c not in ("date", key, "label")]
    return own.dropna(subset=[*names, "label"]), names


def fit_pooled(features: DataFrame, names: list[str], key: str, cutoff: str, seed: int = 7) -> DataFrame:
    """Predictions after the cutoff of one gradient-boosted model of all series, fitted on the rows up to it."""
    index = StringIndexer(inputCol=key, outputCol="__k", handleInvalid="keep")
    stages = [index, VectorAssembler(inputCols=[*names, "__k"], outputCol="__x"), GBTRegressor(featuresCol="__x", labelCol="label", maxIter=10, maxDepth=4, seed=seed)]
    day = F.lit(cutoff).cast("date")
    model = Pipeline(stages=stages).fit(features.where(F.col("date") <= day))
    return model.transform(features.where(F.col("date") > day)).select("date", key, "label", F.col("prediction"))


def importance(spark: SparkSession, features: DataFrame, names: list[str], label: str, seed: int = 7) -> DataFrame:
    """Feature importances of a random forest, one row each (as many as features)."""
    own = VectorAssembler(inputCols=names, outputCol="__x").transform(features.dropna(subset=[*names, label]))
    model = RandomForestRegressor(featuresCol="__x", labelCol=label, numTrees=20, maxDepth=4, seed=seed).fit(own)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
