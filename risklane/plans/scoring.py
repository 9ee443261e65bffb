"""Scoring new payments in bulk, from raw columns to decision records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from risklane.operators import boosting, calibration, decisions, features, forest, metrics as M
from risklane.operators.ordered import TASK_ROWS
from risklane.plans.training import Models

IDENT = "TransactionID"


@dataclass
class Chain:
    """Everything training fixed that scoring needs."""

    fitted: features.Fitted
    models: Models
    forest: forest.Forest


def score_payments(raw: DataFrame, chain: Chain, arms: DataFrame, rates: DataFrame,
                   thompson_seed: int | None = None, limit: int = TASK_ROWS) -> DataFrame:
    """Decision records of payments whose amounts are text; unreadable ones carry an error instead."""
    checked = decisions.checked_amounts(raw)
    built = features.serve(checked, chain.fitted, (IDENT, "tx_type", "error"), limit)
    rows = boosting.assemble(built, chain.fitted.names, (IDENT, "tx_type", "error"))
    # Both models score the same row, so nothing is joined by id.
    strange = forest.with_scores(chain.forest, rows)
    scored = calibration.apply(chain.models.calibrator, boosting.score(chain.models.booster, strange).drop("features"))
    return decisions.decide(scored, "score_cal", "iso_score", chain.models.threshold,
                            arms, rates, thompson_seed)


def anomaly_report(scored: DataFrame) -> DataFrame:
    """AUC and average precision of the anomaly score, and F1, precision, recall of its flag."""
    ranking = M.ranking_metrics(scored, "iso_score").first()
    flagged = M.threshold_metrics(scored, F.col("iso_flag") == 1)
    return flagged.select(
        F.lit(ranking["auc"]).alias("iso_auc"), F.lit(ranking["avg_precision"]).alias("iso_ap"),
        F.col("f1").alias("iso_f1"), F.col("precision").alias("iso_precision"), F.col("recall").alias("iso_recall"))
