"""Isotonic calibration of scores."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F


def fit(val: DataFrame, score: str = "score_raw", label: str = "isFraud") -> IsotonicRegressionModel:
    """Fitted on one weighted point per distinct score, which gives the same curve as the raw rows."""
    points = val.groupBy(score).agg(
        F.avg(label).alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight"))
    return IsotonicRegression(featuresCol=score, labelCol="_label", weightCol="_weight",
                              predictionCol="_calibrated").fit(points)


def apply(model: IsotonicRegressionModel, df: DataFrame, name: str = "score_cal") -> DataFrame:
    """Calibrated score, in single precision; scores outside the fitted range get the end values."""
    return (model.transform(df)
            .withColumn(name, F.col("_calibrated").cast("float").cast("double")).drop("_calibrated"))
