"""Putting the predictions of several models together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def soft_vote(predictions: DataFrame, key: str = "rid", p: str = "p") -> DataFrame:
    """(key, p): the mean of all models' probabilities or predictions for each row."""
    return predictions.groupBy(key).agg(F.avg(p).alias(p))


def aligned(predictions: DataFrame, model: str = "model") -> DataFrame:
    """Predictions of those models only that have as many rows as most models have."""
    sizes = predictions.groupBy(model).agg(F.count(F.lit(1)).alias("__n"))
    most = sizes.groupBy("__n").agg(F.count(F.lit(1)).alias("__m")).agg(F.max_by("__n", F.struct("__m", "__n")).alias("__n"))
    good = sizes.join(F.broadcast(most), "__n", "left_semi").select(model)
    return predictions.join(F.broadcast(good), model, "left_semi")


def stack(predictions: DataFrame, models: list, key: str = "rid", y: str = "y", p: str = "p", classify: bool = True):
    """A linear model, without intercept, over the out-of-fold predictions of each model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    wide = predictions.groupBy(key, y).pivot("model", models).agg(F.first(p))
    rows = VectorAssembler(inputCols=list(map(str, models)), outputCol="features", handleInvalid="skip").transform(wide).withColumn("label", F.col(y).cast("double"))
    kind = LogisticRegression if classify else LinearRegression
    return kind(fitIntercept=False, elasticNetParam=0.5, regParam=0.001).fit(rows), rows


def stack_classes(predictions: DataFrame, models: list, classes: int, key: str = "rid", y: str = "y", p: str = "p", drop_last: bool = True):
    """As ``stack`` for any number of classes: ``p`` holds each model's class probabilities as an array.

    The last probability of each model, which the others imply, is left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    width = classes - 1 if drop_last and classes > 1 else classes
    wide = predictions.groupBy(key, y).pivot("model", models).agg(F.first(F.slice(p, 1, width))).dropna()
    rows = wide.withColumn("features", array_to_vector(F.concat(*(F.col(f"`{m}`") for m in models)))).withColumn("label", F.col(y).cast("double"))
    return LogisticRegression(fitIntercept=False, elasticNetParam=0.5, regParam=0.001).fit(rows), rows
