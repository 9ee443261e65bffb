"""From scores to decisions, actions and routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from risklane.functions import rules, wording
from risklane.operators import routing as R
from risklane.operators.ordered import if_small
from risklane.staging import stage

RECORD = ["transaction_id", "fraud_probability", "iso_anomaly_score", "fraud_decision", "fraud_risk_level",
          "recommended_action", "routed_gateway", "routing_reason", "expected_success_rate"]


def two_stage_signals(df: DataFrame, score: str, anomaly: str, threshold: float) -> DataFrame:
    """Both flags and the combined decision. The caller names the score: raw in batch, calibrated online."""
    return df.withColumns({
        "score_pred": (F.col(score) >= threshold).cast("int"),
        "iso_pred": (F.col(anomaly) >= rules.ISO_FLAG_AT).cast("int"),
        "decision": rules.two_stage(F.col(score), F.col(anomaly), threshold)})


def decision_matrix(signals: DataFrame, label: str = "isFraud") -> DataFrame:
    fraud = F.count_if(F.col(label) == 1)
    legit = F.count_if(F.col(label) == 0)
    return signals.groupBy("decision").agg(
        fraud.alias("fraud"), legit.alias("legit"),
        F.round(fraud * 100 / F.greatest(fraud + legit, F.lit(1)), 4).alias("fraud_pct"))


def novel_capture(signals: DataFrame, label: str = "isFraud") -> DataFrame:
    """Frauds that only the anomaly detector flagged, among all it alone flagged."""
    novel = F.col("decision") == "NOVEL_ANOMALY"
    return signals.agg(F.count_if(novel & (F.col(label) == 1)).alias("novel_fraud"),
                       F.count_if(novel).alias("novel_total"))


def route_by_risk(df: DataFrame, chosen: Column) -> DataFrame:
    """``routed_gateway``: the override for risky payments (default gateway for unknown types), else ``chosen``."""
    forced = rules.override_gateway(F.col("tx_type"))
    return df.withColumn("routed_gateway", F.when(rules.is_risky(F.col("risk")), forced).otherwise(chosen))


def decide(df: DataFrame, score: str, anomaly: str, threshold: float, arms: DataFrame, rates: DataFrame,
           thompson_seed: int | None = None, gateways: Sequence[str] = R.GATEWAYS) -> DataFrame:
    """Decision records, one per payment. Needs TransactionID, tx_type and the two scores.

    Low-risk payments go to the arm with the best posterior mean, or to the best of one draw per arm
    when a seed is given. Arms are those of ``arms`` and, untried, of ``gateways`` and the override. A payment whose ``error`` is set keeps only its id and that text.
    """
    names = R.gateways_of(arms, gateways)
    arms = stage(R.with_untried(arms, [*names, *sorted({*rules.STRONG_GATEWAY.values()} - {*names})]), "arms")
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    scored = df.select("TransactionID", F.col("tx_type"), F.col("error"), F.col(score).alias("_p"),
                       F.col(anomaly).alias("_a")).withColumns({
        "decision": rules.two_stage(F.col("_p"), F.col("_a"), threshold),
        "risk": rules.risk_level(F.col("_p")),
        "_type": rules.routing_type(F.coalesce("tx_type", F.lit("")))})
    if thompson_seed is None:
        best = R.best_by_mean(arms).select(F.col("tx_type").alias("_type"), F.col("gateway").alias("_learned"))
        scored = scored.join(F.broadcast(best.filter(F.col("_type").isin(*rules.PAYMENT_TYPES))), "_type", "left")
    else:
        by_type = scored.withColumnsRenamed({"tx_type": "_given", "_type": "tx_type"})
        scored = R.thompson_route(by_type, arms, seed=thompson_seed, gateways=names).withColumnsRenamed(
            {"tx_type": "_type", "_given": "tx_type", "routed_gateway": "_learned"})
    routed = route_by_risk(scored, F.col("_learned"))
    state = arms.select(F.col("tx_type").alias("_arm_type"), F.col("gateway").alias("_arm_gateway"),
                        F.col("posterior_mean").alias("_mean"), F.col("n_trials").alias("_trials"))
    routed = routed.join(if_small(state), (F.col("_type") == F.col("_arm_type"))
                         & (F.col("routed_gateway") == F.col("_arm_gateway")), "left")
    card_rates = rates.filter(F.col("tx_type") == "CARD").select(
        F.col("gateway").alias("_rate_gateway"), F.col("rate").alias("_card_rate"))
    routed = routed.join(if_small(card_rates), F.col("routed_gateway") == F.col("_rate_gateway"), "left")
    is_known = F.coalesce(F.upper("tx_type").isin(*rules.PAYMENT_TYPES), F.lit(False))
    expected = F.coalesce(F.when(is_known, F.col("_mean")), F.col("_card_rate"), F.lit(rules.DEFAULT_RATE))
    reason = wording.routing_reason(F.col("risk"), F.col("routed_gateway"), F.col("_mean"), F.col("_trials"))
    values = {
        "fraud_probability": F.round("_p", 4), "iso_anomaly_score": F.round("_a", 4), "fraud_decision": F.col("decision"),
        "fraud_risk_level": F.col("risk"), "recommended_action": rules.action(F.col("decision"), F.col("risk")),
        "routed_gateway": F.col("routed_gateway"), "routing_reason": reason, "expected_success_rate": F.round(expected, 4)}
    ok = F.col("error").isNull()
    return routed.select(F.col("TransactionID").cast("string").alias("transaction_id"), F.upper("tx_type").alias("tx_type"),
                         *[F.when(ok, value).alias(name) for name, value in values.items()], "error")


def score_record(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Label, label text and risk of each score, on the scoring cut-points."""
    flagged = F.col(score) >= threshold
    return df.select("TransactionID", F.round(score, 4).alias("probability"), flagged.cast("int").alias("label"),
                     F.when(flagged, "FRAUD").otherwise("LEGITIMATE").alias("label_str"),
                     rules.risk_level(F.col(score), rules.SCORING_CUTS).alias("risk_level"),
                     F.lit(threshold).alias("threshold"))


def checked_amounts(raw: DataFrame, amount: str = "amount_text") -> DataFrame:
    """Amounts from text; one that is not a number sets ``error`` instead of failing the batch."""
    number = F.expr(f"try_cast({amount} AS double)")
    bad = F.col(amount).isNotNull() & number.isNull()
    return raw.withColumns({
        "TransactionAmt": F.coalesce(number, F.lit(0.0)),
        "error": F.when(bad, F.concat(F.lit("could not convert string to float: '"), F.col(amount), F.lit("'")))})


def explain(records: DataFrame, items: Column, arms: DataFrame) -> DataFrame:
    """Fraud and routing explanations of decision records; ``items`` are the drivers of each record."""
    seconds = R.second_best(arms).withColumnRenamed("tx_type", "_kind")
    joined = records.join(if_small(seconds), F.col("tx_type") == F.col("_kind"), "left")
    return joined.select(
        "transaction_id",
        wording.fraud_explanation(F.col("fraud_decision"), F.col("fraud_risk_level"), F.col("recommended_action"),
                                  F.col("fraud_probability"), items).alias("explanation"),
        wording.routing_explanation(F.col("routed_gateway"), F.col("fraud_risk_level"), F.col("tx_type"),
                                    F.col("expected_success_rate")).alias("routing_explanation"),
        wording.counterfactual(F.col("expected_success_rate"), F.col("second_gateway"),
                               F.round("second_rate", 4)).alias("counterfactual"))
