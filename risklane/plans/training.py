"""The training chain: split, features, models, calibration, and one row of metrics per run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from risklane.operators import boosting, calibration, features, forest, metrics as M, oversample, splits
from risklane.operators.ordered import TASK_ROWS
from risklane.sources import files
from risklane.staging import spread, stage


@dataclass
class Parts:
    """Assembled rows (TransactionID, isFraud, features) of the three splits, and what train fixed."""

    train: DataFrame
    val: DataFrame
    test: DataFrame
    fitted: features.Fitted


def prepare(payments: DataFrame, limit: int = TASK_ROWS) -> Parts:
    """Split by time, fit on train, build all three; each part is written once as it is read often."""
    raw = splits.parts(payments, limit=limit)
    fitted = features.fit(raw["train"], limit)
    built = {name: spread(stage(boosting.assemble(features.build(df, fitted, limit), fitted.names), name))
             for name, df in raw.items()}
    return Parts(**built, fitted=fitted)


@dataclass
class Models:
    booster: boosting.Booster
    calibrator: IsotonicRegressionModel
    threshold: float


def train(parts: Parts, rounds: int = boosting.ROUNDS, oversampled: bool = True, seed: int = 42) -> Models:
    """Boosted trees on the balanced training rows; threshold and calibration from the validation rows."""
    rows = parts.train
    if oversampled:
        rows = spread(stage(oversample.balance(parts.train, seed=seed), "balanced"))
    booster = boosting.fit(rows, parts.val, rounds, seed)
    val = stage(boosting.score(booster, parts.val).drop("features"), "val_scores")
    return Models(booster, calibration.fit(val), M.tuned_threshold(val, "score_raw"))


def run_metrics(models: Models, parts: Parts, run_id: str, stage_name: str = "None") -> DataFrame:
    """(run_id, stage, metric, value) of one training run, on raw scores as tuned."""
    rows = []
    for name, part in (("val", parts.val), ("test", parts.test)):
        scored = stage(boosting.score(models.booster, part).drop("features"), f"{name}_scores")
        ranking = M.ranking_metrics(scored, "score_raw").first()
        at = M.threshold_metrics(scored, F.col("score_raw") >= models.threshold).first()
        rows += [(run_id, stage_name, f"{name}_{metric}", value) for metric, value in (
            ("auc", ranking["auc"]), ("ap", ranking["avg_precision"]), ("f1", at["f1"]),
            ("precision", at["precision"]), ("recall", at["recall"]))]
    rows.append((run_id, stage_name, "threshold", models.threshold))
    return parts.test.sparkSession.createDataFrame(rows, "run_id string, stage string, metric string, value double")


# The entries of the metrics object, and how many features the importance object lists.
REPORTED = ["val_auc", "val_f1", "test_auc", "test_f1", "test_precision", "test_recall", "test_ap"]
LISTED = 30


def metrics_object(runs: DataFrame) -> DataFrame:
    """The metrics of one run side by side, to four places; the threshold as it is."""
    return runs.agg(*[F.round(F.max(F.when(F.col("metric") == name, F.col("value"))), 4).alias(name) for name in REPORTED],
                    F.max(F.when(F.col("metric") == "threshold", F.col("value"))).alias("threshold"))


def write_artifacts(models: Models, parts: Parts, runs: DataFrame, path: str) -> None:
    """Threshold, metrics, strongest features and feature names of a training run as JSON texts under ``path``."""
    spark = runs.sparkSession
    files.write_object(metrics_object(runs), f"{path}/test_metrics.json")
    files.write_object(spark.createDataFrame([(models.threshold,)], "threshold double"), f"{path}/threshold.json")
    files.write_series(boosting.importance(models.booster, parts.fitted.names, parts.train), f"{path}/feature_importance.json",
                       "feature", "importance", LISTED)
    files.write_list(spark, parts.fitted.names, f"{path}/feature_names.json")


def best_run(runs: DataFrame, metric: str = "test_auc") -> DataFrame:
    """The run with the highest value of ``metric``."""
    return (runs.filter(F.col("metric") == metric).orderBy(F.desc("value"), "run_id").limit(1)
            .select("run_id", "stage", F.col("value").alias(metric)))


def compare_stages(runs: DataFrame, left: str = "Staging", right: str = "Production") -> DataFrame:
    """Metrics of two stages side by side; a metric only one of them has stays null for the other."""
    sides = [runs.filter(F.col("stage") == name).select("metric", F.col("value").alias(name.lower()))
             for name in (left, right)]
    return sides[0].join(sides[1], "metric", "full_outer")
