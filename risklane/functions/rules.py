"""Decision rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Upper ends of LOW, MEDIUM and HIGH (fixed values); a score equal to an end belongs above it.
DECISION_CUTS = (0.30, 0.55, 0.75)
SCORING_CUTS = (0.3, 0.6, 0.8)
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

PAYMENT_TYPES = ("UPI", "CARD", "NETBANKING", "WALLET")
ISO_FLAG_AT = 0.5

# Strongest-authentication gateway per payment type for HIGH and CRITICAL risk (fixed values).
STRONG_GATEWAY = {"CARD": "Stripe", "UPI": "Razorpay", "NETBANKING": "CCAvenue", "WALLET": "Razorpay"}
DEFAULT_GATEWAY = "Razorpay"
DEFAULT_RATE = 0.85


def risk_level(score: Column, cuts: Sequence[float] = DECISION_CUTS) -> Column:
    level = F.lit(LEVELS[-1])
    for cut, name in reversed(list(zip(cuts, LEVELS))):
        level = F.when(score < cut, name).otherwise(level)
    return level


def two_stage(score: Column, anomaly: Column, threshold: float) -> Column:
    """Combine the supervised flag with the anomaly flag."""
    known, strange = score >= threshold, anomaly >= ISO_FLAG_AT
    return (F.when(known & strange, "CONFIRMED_FRAUD").when(strange, "NOVEL_ANOMALY")
            .when(known, "KNOWN_FRAUD").otherwise("LEGITIMATE"))


def action(decision: Column, risk: Column) -> Column:
    return (F.when(decision == "CONFIRMED_FRAUD", "BLOCK").when(decision == "NOVEL_ANOMALY", "REVIEW")
            .when(risk.isin("HIGH", "CRITICAL"), "REVIEW").otherwise("ALLOW"))


def routing_type(tx_type: Column) -> Column:
    """Upper-cased payment type; an unknown one is routed as CARD."""
    upper = F.upper(tx_type)
    return F.when(upper.isin(*PAYMENT_TYPES), upper).otherwise("CARD")


def override_gateway(tx_type: Column) -> Column:
    """Gateway forced for risky payments, by the type as given; unknown types get the default."""
    chosen = F.lit(DEFAULT_GATEWAY)
    for name, gateway in STRONG_GATEWAY.items():
        chosen = F.when(F.upper(tx_type) == name, gateway).otherwise(chosen)
    return chosen


def is_risky(risk: Column) -> Column:
    return risk.isin("HIGH", "CRITICAL")


def direction(value: Column) -> Column:
    return F.when(value > 0, "↑ increases fraud").otherwise("↓ decreases fraud")
