"""Explanations of decisions, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from risklane.functions.rules import direction, is_risky

# Fixed wordings, in printf form.
CONFIRMED = (
    "Both fraud detection systems flagged this transaction. Calibrated fraud probability: %.1f%%. "
    "Risk level: %s.%s Recommended action: %s.")
NOVEL = (
    "This transaction shows unusual patterns not seen in historical fraud data. Fraud probability: %.1f%%. "
    "The anomaly detector flagged it as statistically unusual.%s Recommended action: %s — manual review advised.")
KNOWN = "This transaction matches known fraud patterns. Fraud probability: %.1f%%.%s Recommended action: %s."
LEGITIMATE = (
    "Transaction appears legitimate. Fraud probability: %.1f%% (below threshold).%s Recommended action: ALLOW.")
KEY_DRIVERS = " Key drivers: "
DRIVER = "%s (%s%.3f)"
FORCED_ROUTE = (
    "Routed to %s due to elevated fraud risk (%s). This gateway provides strongest authentication for %s "
    "transactions. Expected success rate: %.1f%%.")
LEARNED_ROUTE = (
    "Routed to %s via Thompson Sampling policy. Learned success rate for %s: %.1f%%. "
    "This gateway is currently optimal for this transaction type.")
RUNNER_UP = "If routed to %s instead, expected success rate would be %.1f%% (%+.1f%% difference)."
OVERRIDE_REASON = "Fraud-risk override (%s) → strongest-auth gateway"
LEARNED_REASON = "Thompson Sampling → %s (posterior mean: %.3f, trials: %d)"
DRIFT_FOUND = (
    "Model drift detected. %d features show significant distribution shift (PSI > 0.20). "
    "Model AUC has degraded by %.4f. Fraud rate has shifted +%s%% from training baseline. "
    "Recommendation: retrain on recent data (last 90 days).")
NO_DRIFT = (
    "Model health nominal. No significant drift detected. "
    "AUC stable, feature distributions within acceptable bounds.")
RETRAIN_REASON = "PSI > 0.20 on %d features: %s. AUC degradation: %.4f. Fraud rate shift: %s%%."
MONITOR_REASON = "No significant drift detected. Max PSI: %.3f. AUC stable at %.4f."


def even(value: Column, digits: int) -> Column:
    """Rounded on the exact binary value, ties to even, as the formatted numbers are expected to be.

    Java rounds half up on the shortest decimal text instead. Only a value whose scaled fraction is next to one
    half needs more than adding a half; its whole part is taken off first, so its size does not matter.
    """
    scale = 10**digits
    size = F.abs(value.cast("double"))
    scaled = size * scale
    off = F.abs(scaled - F.floor(scaled) - 0.5)
    plain = F.floor(scaled + 0.5).cast("double") / scale
    near = (off <= 1e-6) | (scaled >= 1e9)
    return F.signum(value.cast("double")) * F.when(near, _even_exact(size, scale)).otherwise(plain)


def _even_exact(size: Column, scale: int) -> Column:
    """``even`` of a value of at least 0: its fraction in units of 2^-56, bits below that apart in ``below``."""
    unit = F.lit(1 << 56).cast("decimal(18,0)")
    power = F.lit(scale).cast("decimal(5,0)")

    def bits(v: Column) -> Column:
        units = (v - F.floor(v)) * float(1 << 56)
        return F.struct(F.floor(v).alias("whole"), units.cast("long").alias("bits"),
                        ((units - F.floor(units)) * scale).alias("below"))

    def parts(s: Column) -> Column:
        scaled = s["bits"].cast("decimal(19,0)") * power + F.floor(s["below"]).cast("decimal(6,0)")
        return F.struct(s["whole"].alias("whole"), scaled.alias("scaled"), (scaled % unit).alias("rest"),
                        (s["below"] > F.floor(s["below"])).alias("lost"))

    def rounded(s: Column) -> Column:
        steps = ((s["scaled"] - s["rest"]) / unit).cast("long")
        twice = s["rest"] * 2
        up = (twice > unit) | ((twice == unit) & (s["lost"] | (steps % 2 == 1)))
        return (s["whole"].cast("double") * scale + (steps + up.cast("long")).cast("double")) / scale

    # One-element arrays bind each step to a name, so the value is worked out once.
    return F.get(F.transform(F.transform(F.transform(F.array(size), bits), parts), rounded), F.lit(0))


def one_decimal(value: Column) -> Column:
    """As text; a shift from a rate of zero is "inf", and "nan" when it stays zero."""
    return F.when(value.isNull(), "nan").when(value == float("inf"), "inf") \
            .otherwise(F.format_string("%.1f", even(value, 1)))


def drivers(contributions: dict[str, Column]) -> Column:
    """array<struct<feature, value>> of named contributions."""
    return F.array(*[F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"))
                     for name, value in contributions.items()])


def strongest(items: Column, n: int) -> Column:
    """The ``n`` drivers largest in absolute value; by name on ties. Sorted inside the row."""
    keyed = F.transform(items, lambda d: F.struct(
        (-F.abs(d["value"])).alias("rank"), d["feature"].alias("feature"), d["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda d: F.struct(
        d["feature"].alias("feature"), d["value"].alias("value"), direction(d["value"]).alias("direction")))


def key_drivers(items: Column) -> Column:
    """The first three drivers with their sign; empty without drivers."""
    texts = F.transform(F.slice(items, 1, 3), lambda d: F.format_string(
        DRIVER, d["feature"], F.when(d["value"] > 0, "+").otherwise(""), even(d["value"], 3)))
    return F.when(F.size(items) > 0, F.concat(F.lit(KEY_DRIVERS), F.array_join(texts, ", "))).otherwise("")


def fraud_explanation(decision: Column, risk: Column, action: Column, score: Column, items: Column) -> Column:
    pct, listed = even(score * 100, 1), key_drivers(items)
    return (F.when(decision == "CONFIRMED_FRAUD", F.format_string(CONFIRMED, pct, risk, listed, action))
            .when(decision == "NOVEL_ANOMALY", F.format_string(NOVEL, pct, listed, action))
            .when(decision == "KNOWN_FRAUD", F.format_string(KNOWN, pct, listed, action))
            .otherwise(F.format_string(LEGITIMATE, pct, listed)))


def routing_explanation(gateway: Column, risk: Column, tx_type: Column, rate: Column) -> Column:
    pct = even(rate * 100, 1)
    return F.when(is_risky(risk), F.format_string(FORCED_ROUTE, gateway, risk, tx_type, pct)) \
            .otherwise(F.format_string(LEARNED_ROUTE, gateway, tx_type, pct))


def routing_reason(risk: Column, gateway: Column, mean: Column, trials: Column) -> Column:
    return F.when(is_risky(risk), F.format_string(OVERRIDE_REASON, risk)) \
            .otherwise(F.format_string(LEARNED_REASON, gateway, even(mean, 3), trials))


def counterfactual(rate: Column, second: Column, second_rate: Column) -> Column:
    """What the runner-up gateway would change; empty when the type has none."""
    text = F.format_string(RUNNER_UP, second, even(second_rate * 100, 1), even((rate - second_rate) * 100, 1))
    return F.coalesce(F.when(second.isNotNull(), text), F.lit(""))
