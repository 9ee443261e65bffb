"""Published outputs whose inputs are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklane.functions import beta, rules
from risklane.operators import drift as D, metrics as M, profile as P, routing as R


def test_cost_model(spark):
    counts = spark.createDataFrame([(965, 395, 2118, 85103)], "tp long, fp long, fn long, tn long")
    row = M.cost_model(counts).first()
    assert (row["cost_false_positives"], row["cost_false_negatives"], row["cost_review"], row["baseline_cost"],
            row["value_prevented"], row["net_benefit"], row["roi_pct"]) == (
        474000, 5083200, 272000, 7399200, 2316000, 1570000, 21.2)


PSI = {"V258": 1.9702, "C4": 0.0383, "V317": 0.008, "C8": 0.0478, "V69": 0.0441, "dow_cos": 0.2472, "V201": 0.0515,
       "V306": 0.0063, "V126": 0.0063, "V133": 0.0, "C14": 0.0071, "card6": 9.2114, "V294": 0.0072, "V187": 0.0444,
       "V95": 0.007, "V287": 0.0027, "V225": 1.9702, "M4": 0.0083, "V128": 0.0143, "dow_sin": 3.7557}
CONCEPT = [(1, 0.8929, 0.0306), (2, 0.8711, 0.0291), (9, 0.8845, 0.044), (10, 0.8792, 0.0403)]


def test_retrain_rule(spark):
    psi = spark.createDataFrame([(f, b, v if b == 10 else 9.0) for f, v in PSI.items() for b in (1, 10)],
                                "feature string, batch int, psi double")
    concept = spark.createDataFrame(CONCEPT, "batch int, auc double, fraud_rate double")
    row = D.retrain_rule(psi, concept, concept, list(PSI)).first()
    assert row["recommendation"] == "RETRAIN" and row["should_retrain"]
    assert row["high_psi_features"] == ["V258", "dow_cos", "card6", "V225", "dow_sin"]
    assert (row["auc_degradation"], row["fraud_rate_shift_pct"]) == (0.0137, 31.7)
    assert row["reason"] == ("PSI > 0.20 on 5 features: ['V258', 'dow_cos', 'card6', 'V225', 'dow_sin']. "
                             "AUC degradation: 0.0137. Fraud rate shift: 31.7%.")


def test_monitor_when_calm(spark):
    psi = spark.createDataFrame([("a", 1, 0.01)], "feature string, batch int, psi double")
    concept = spark.createDataFrame([(1, 0.9, 0.03)], "batch int, auc double, fraud_rate double")
    row = D.retrain_rule(psi, concept, concept, ["a"]).first()
    assert (row["recommendation"], row["auc_degradation"], row["high_psi_features"]) == ("MONITOR", 0.0, [])


ARMS = [("UPI", "Razorpay", 1587, 260, 0.8592, 0.843, 0.8747), ("UPI", "PayU", 35, 16, 0.6863, 0.5539, 0.8048),
        ("UPI", "Stripe", 14, 9, 0.6087, 0.4066, 0.7929), ("UPI", "CCAvenue", 522, 95, 0.846, 0.8165, 0.8734),
        ("CARD", "Razorpay", 90, 12, 0.8824, 0.8135, 0.9371), ("CARD", "PayU", 94, 14, 0.8704, 0.8012, 0.9266),
        ("CARD", "Stripe", 2154, 128, 0.9439, 0.9341, 0.953), ("CARD", "CCAvenue", 12, 6, 0.6667, 0.4404, 0.8579),
        ("NETBANKING", "Razorpay", 31, 8, 0.7949, 0.6567, 0.9045), ("NETBANKING", "PayU", 326, 34, 0.9056, 0.8733, 0.9335),
        ("NETBANKING", "Stripe", 9, 5, 0.6429, 0.3857, 0.8614), ("NETBANKING", "CCAvenue", 1851, 162, 0.9195, 0.9073, 0.931),
        ("WALLET", "Razorpay", 1941, 187, 0.9121, 0.8997, 0.9238), ("WALLET", "PayU", 19, 9, 0.6786, 0.4982, 0.8348),
        ("WALLET", "Stripe", 95, 21, 0.819, 0.7443, 0.8833), ("WALLET", "CCAvenue", 253, 33, 0.8846, 0.8452, 0.9189)]


def test_posterior_and_interval(spark):
    log = [(t, g, y) for t, g, a, b, *_ in ARMS for y, n in ((1, a - 1), (0, b - 1)) for _ in range(n)]
    arms = R.with_interval(R.posterior(spark.createDataFrame(log, "tx_type string, gateway string, success int"))).collect()
    got = {(r["tx_type"], r["gateway"]): (r["alpha"], r["beta"], round(r["posterior_mean"], 4), r["ci"], r["n_trials"])
           for r in arms}
    for t, g, a, b, mean, low, high in ARMS:
        assert got[t, g] == (a, b, mean, [low, high], a + b - 2)


def test_beta_draws_follow_the_distribution():
    seeds = np.arange(200_000, dtype=np.int64)
    for a, b in ((1.0, 1.0), (35.0, 16.0), (2.0, 9.0)):
        draws = beta.beta_draws(seeds, np.full(len(seeds), a), np.full(len(seeds), b))
        for p in (0.1, 0.5, 0.9):
            cut = beta.beta_quantile(p, np.array([a]), np.array([b]))[0]
            assert (draws < cut).mean() == pytest.approx(p, abs=0.005)


@pytest.mark.parametrize("cuts, edges", [
    (rules.DECISION_CUTS, [(0.2999, "LOW"), (0.30, "MEDIUM"), (0.55, "HIGH"), (0.75, "CRITICAL"), (1.0, "CRITICAL")]),
    (rules.SCORING_CUTS, [(0.0, "LOW"), (0.3, "MEDIUM"), (0.6, "HIGH"), (0.8, "CRITICAL")])])
def test_risk_edges(spark, cuts, edges):
    df = spark.createDataFrame(edges, "p double, want string")
    assert df.filter(rules.risk_level(F.col("p"), cuts) != F.col("want")).count() == 0


def test_known_fraud_at_medium_risk_is_allowed(spark):
    row = spark.range(1).select(rules.action(F.lit("KNOWN_FRAUD"), F.lit("MEDIUM")).alias("a")).first()
    assert row["a"] == "ALLOW"


def test_amount_bands(spark):
    amounts = [(-1.0, None), (0.0, None), (50.0, "₹0-50"), (50.01, "₹51-100"), (1000.0, "₹501-1k"),
               (50000.0, "₹1k+"), (50000.01, None)]
    df = spark.createDataFrame(amounts, "x double, want string")
    assert df.filter(~P.amount_band(F.col("x")).eqNullSafe(F.col("want"))).count() == 0
